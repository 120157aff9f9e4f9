"""Removal of repeated byte passages by distributed prefix doubling over position-rank pairs.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id.
Texts are packed into batches, and positions are ranked in rounds of growing length; a round sorts
the (rank, document) pairs of all batches, bucket by bucket, and positions whose rank is unique to
their document drop out:

1. Ranks of KEY bytes, and of the whole stretch around them. Only anchors take part: the KEY-byte
   string of least rank in each LENGTH-byte string, which is the same wherever that string stands, so
   no pair of equal strings is lost. An anchor stands for the strings in which it is least; a pair
   (rank of its KEY bytes, rank of all bytes of its strings) settles all of them at once where the
   pair starts in a smaller document, and drops them where even the KEY bytes don't.
2. Ranks of LENGTH bytes, past the threshold, for the strings that are left: those at the edges of
   repeats, and one of each stretch that they may equal.

Ranks are 64-bit fingerprints (88 bits and the bucket's for a pair). A batch asks about a rank once,
for its least document, so a passage that a third of all documents share is one row for each batch.

Defined results: null and empty texts, and texts shorter than LENGTH, lose nothing and repeat
nothing; rows that share an id never remove each other; rows without id lose nothing and remove
nothing; an empty table gives an empty result; further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import documents, small_batches, stored

LENGTH, KEY = 50, 24
#: Bytes of text in a batch; a longer document is a batch of its own.
BATCH_BYTES = 2 << 20
#: Bytes of text for each bucket of ranks.
BUCKET_BYTES = 12 << 20
#: Strings ranked at once; their places take the low 20 bits of a sort key.
CHUNK = 1 << 19
NO_ID = np.iinfo(np.int64).min

_R = np.random.default_rng(20_240_811)
_BYTE = _R.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _R.integers(0, 2, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Ranker:
    """Fingerprints of any stretch of a piece of text, from running sums."""

    power = _powers(_BASE, CHUNK + LENGTH + 1)
    inverse = _powers(_INVERSE, CHUNK + LENGTH + 1)

    def __init__(self, piece: np.ndarray):
        self.sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * self.inverse[: len(piece)], out=self.sums[1:])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.power[a] + (b - a).astype(np.uint64))

    def ranks(self, n: int) -> np.ndarray:
        """Of all stretches of n bytes."""
        return mixed((self.sums[n:] - self.sums[:-n]) * self.power[: len(self.sums) - n])


def least_in(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


class Batch:
    """The texts of one row of the batch table, joined."""

    def __init__(self, row: dict):
        self.name, self.ids, sizes = row["batch"], row["ids"], np.asarray(row["sizes"], np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["packed"], max_output_size=int(sizes.sum()) + 1) if len(row["packed"]) else b""
        self.text = np.frombuffer(raw, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        # Documents that can repeat or be repeated, in the order of the batch, which is that of ids.
        self.live = np.array([i is not None for i in self.ids], bool) & (sizes >= LENGTH)
        self.order = np.array([NO_ID if i is None else i for i in self.ids], np.int64)

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(offset, piece, whole strings' starts in it) of all pieces."""
        n = len(self.text)
        for at in range(0, n, CHUNK):
            to = min(at + CHUNK, n)
            whole = np.zeros(to - at, bool)
            first, last = np.searchsorted(self.ends, at, "right"), np.searchsorted(self.starts, to, "left")
            for d in range(first, last):
                if self.live[d]:
                    whole[max(self.starts[d] - at, 0) : max(self.ends[d] - LENGTH + 1 - at, 0)] = True
            if whole.any():
                yield at, self.text[at : min(to + LENGTH - 1, n)], np.flatnonzero(whole)

    def anchors(self) -> dict[str, np.ndarray]:
        """Of each anchor: the first and last start of its strings, its document, the ranks of its KEY bytes and of its stretch."""
        parts = []
        for at, piece, starts in self.chunks():
            ranker = Ranker(piece)
            key = ranker.ranks(KEY)
            packed = (key & ~np.uint64(0xFFFFF)) | np.arange(len(key), dtype=np.uint64)
            owner = (least_in(packed, LENGTH - KEY + 1)[starts] & np.uint64(0xFFFFF)).astype(np.int64)
            new = np.ones(len(starts), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
            low, high, anchor = starts[first], starts[last], owner[first]
            whole = mixed(ranker.rank(low, high + LENGTH) + (anchor - low).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
            parts.append((low + at, high + at, np.searchsorted(self.ends, low + at, "right"), mixed(key[anchor]), whole & np.uint64(2**48 - 1)))
        if not parts:
            return {k: np.zeros(0, np.uint64 if k in ("key", "whole") else np.int64) for k in ("low", "high", "doc", "key", "whole")}
        return dict(zip(("low", "high", "doc", "key", "whole"), map(np.concatenate, zip(*parts, strict=True)), strict=True))


def first_of(*ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of all equal rank tuples, and for each tuple the number of its first."""
    if not len(ranks[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((np.arange(len(ranks[0])), *ranks[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([r[order[1:]] != r[order[:-1]] for r in ranks], axis=0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _bytes_of(x: np.ndarray, n: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _from_bytes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel().astype(np.uint64)


def bucket_of(rank: np.ndarray, buckets: int) -> np.ndarray:
    return ((rank >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, then document, then place; the buckets in it, and their bounds."""
    order = np.lexsort((np.arange(len(bucket)), doc, bucket))
    found, at = np.unique(bucket[order], return_index=True)
    return order, found, np.append(at, len(order))


def first_round(batch: Batch, buckets: int):
    """What the batch asks: its anchors, the places of the different pairs, the pair of each anchor, and their order by bucket."""
    a = batch.anchors()
    first, group = first_of(a["key"], a["whole"])
    order, found, bounds = by_bucket(bucket_of(a["key"][first], buckets), a["doc"][first])
    return a, first, group, order, found, bounds


def answers(rows, found: np.ndarray, bounds: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The answer to each question, in the order in which they were made."""
    flat = np.zeros(len(order), np.uint8)
    at = {int(b): i for i, b in enumerate(found)}
    for r in rows or ():
        i = at[r["bucket"]]
        flat[bounds[i] : bounds[i + 1]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["said"], max_output_size=int(bounds[i + 1] - bounds[i])), np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = flat
    return out


def second_round(batch: Batch, buckets: int, said):
    """From the answers to the first: the starts known to repeat, and of the strings left: their starts, the places of the different ones, the group of each, and their order by bucket."""
    a, first, group, order, found, bounds = first_round(batch, buckets)
    codes = answers(said, found, bounds, order)
    repeats = (codes[group] == 1) | (batch.order[a["doc"]] > batch.order[a["doc"][first]][group])
    asked = ~repeats & (codes[group] == 2)
    known = _ranges(a["low"][repeats], a["high"][repeats])
    low, high = a["low"][asked], a["high"][asked]
    starts = _ranges(low, high)
    doc = np.repeat(a["doc"][asked], high - low + 1)
    rank = np.empty(len(starts), np.uint64)
    for at, piece, _ in batch.chunks():
        i, j = np.searchsorted(starts, [at, at + CHUNK])
        rank[i:j] = Ranker(piece).rank(starts[i:j] - at, starts[i:j] - at + LENGTH)
    one, of = first_of(rank)
    order, found, bounds = by_bucket(bucket_of(rank[one], buckets), doc[one])
    return known, starts, doc, rank, one, of, order, found, bounds


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = high - low + 1
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _questions(batch: Batch, ranks: list[tuple[np.ndarray, int]], doc: np.ndarray, order: np.ndarray, found: np.ndarray, bounds: np.ndarray) -> Iterator[dict]:
    pack = zstandard.ZstdCompressor(level=1)
    for b, i, j in zip(found.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = order[i:j]
        ids = batch.order[doc[own]]
        yield {"bucket": b, "batch": batch.name, "ranks": b"".join(_bytes_of(r[own], n) for r, n in ranks), "ids": pack.compress(np.diff(ids, prepend=0).astype("<i8").tobytes())}


ASKED = "bucket long, batch string, ranks binary, ids binary"
_ASKED = pa.schema([("bucket", pa.int64()), ("batch", pa.string()), ("ranks", pa.binary()), ("ids", pa.binary())])
SAID = "bucket long, batch string, said binary"
_SAID = pa.schema([("bucket", pa.int64()), ("batch", pa.string()), ("said", pa.binary())])
BATCHES = "batch string, n_bytes long, ids array<long>, sizes array<int>, packed binary"
_BATCHES = pa.schema([("batch", pa.string()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("packed", pa.binary())])
PAIR, FULL = (5, 6), (7,)  # bytes kept of each rank; the bucket says more


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def row() -> pa.RecordBatch:
        docs = sorted(held, key=lambda x: (NO_ID if x[0] is None else x[0]))
        raw = b"".join(x[1] for x in docs)
        made = {"batch": uuid.uuid4().hex, "n_bytes": len(raw), "ids": [x[0] for x in docs], "sizes": [len(x[1]) for x in docs], "packed": zstandard.ZstdCompressor(level=3).compress(raw) if raw else b""}
        return pa.RecordBatch.from_pylist([made], _BATCHES)

    for batch in batches:
        texts = pc.fill_null(batch.column(1), "").cast(pa.binary())
        for i, text in zip(batch.column(0), texts, strict=True):
            value = text.as_py()
            if held and size + len(value) > BATCH_BYTES:
                yield row()
                held, size = [], 0
            held.append((i.as_py(), value))
            size += len(value)
    if held:
        yield row()


def _ask_first(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            batch = Batch(row)
            a, first, _, order, found, bounds = first_round(batch, buckets)
            ranks = [(a["key"][first] & np.uint64(2**40 - 1), PAIR[0]), (a["whole"][first], PAIR[1])]
            yield pa.RecordBatch.from_pylist(list(_questions(batch, ranks, a["doc"][first], order, found, bounds)), _ASKED)

    return run


def _ask_second(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            batch = Batch(row)
            _, _, doc, rank, one, _, order, found, bounds = second_round(batch, buckets, row["first"])
            yield pa.RecordBatch.from_pylist(list(_questions(batch, [(rank[one], FULL[0])], doc[one], order, found, bounds)), _ASKED)

    return run


def judged_pairs(key: np.ndarray, whole: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """1: the pair is in a smaller document; 2: its strings must be compared one by one; 0: they are new."""
    order = np.lexsort((ids, whole, key))
    k, w, d = key[order], whole[order], ids[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new_pair = new_key.copy()
    new_pair[1:] |= w[1:] != w[:-1]
    pair_at, key_at = np.flatnonzero(new_pair), np.flatnonzero(new_key)
    least_pair = d[pair_at][np.cumsum(new_pair) - 1]
    in_key = np.cumsum(new_key) - 1
    least_key = np.minimum.reduceat(d, key_at)[in_key]
    repeated = least_pair < d
    open_key = np.logical_or.reduceat(~repeated & (least_key < d), key_at)[in_key]
    out = np.empty(len(k), np.uint8)
    out[order] = np.where(repeated, 1, np.where(open_key, 2, 0))
    return out


def judged_ranks(rank: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """1 where the rank is in a smaller document too."""
    order = np.lexsort((ids, rank))
    r, d = rank[order], ids[order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    out = np.empty(len(r), np.uint8)
    out[order] = d[np.flatnonzero(new)][np.cumsum(new) - 1] < d
    return out


def _judge(widths: tuple[int, ...]):
    def run(table: pa.Table) -> pa.Table:
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        ranks: list[list[np.ndarray]] = [[] for _ in widths]
        ids = []
        for raw, packed in zip(table.column("ranks").to_pylist(), table.column("ids").to_pylist(), strict=True):
            n, at = len(raw) // sum(widths), 0
            for i, w in enumerate(widths):
                ranks[i].append(_from_bytes(raw[at : at + n * w], w))
                at += n * w
            ids.append(np.cumsum(np.frombuffer(unpack.decompress(packed, max_output_size=8 * n), "<i8")))
        said = (judged_pairs if len(widths) > 1 else judged_ranks)(*map(np.concatenate, ranks), np.concatenate(ids))
        ends = np.cumsum([len(x) for x in ids])
        parts = [pack.compress(said[b - len(x) : b].tobytes()) for b, x in zip(ends.tolist(), ids, strict=True)]
        return pa.table([table.column("bucket"), table.column("batch"), pa.array(parts, pa.binary())], schema=_SAID)

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(buckets: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            batch = Batch(row)
            known, starts, doc, _, one, of, order, found, bounds = second_round(batch, buckets, row["first"])
            codes = answers(row["second"], found, bounds, order)
            repeats = (codes[of] == 1) | (batch.order[doc] > batch.order[doc[one]][of])
            step = np.zeros(len(batch.text) + 1, np.int32)
            for at in (known, starts[repeats]):
                np.add.at(step, at, 1)
                np.add.at(step, at + LENGTH, -1)
            covered = np.cumsum(step[:-1]) > 0
            edge = covered.copy()
            edge[1:] &= ~covered[:-1]
            full = batch.starts[batch.ends > batch.starts]
            edge[full] = covered[full]
            removed, spans = np.concatenate([[0], np.cumsum(covered)]), np.concatenate([[0], np.cumsum(edge)])
            kept = []
            for a, b in zip(batch.starts.tolist(), batch.ends.tolist(), strict=True):
                left = batch.text[a:b] if removed[b] == removed[a] else batch.text[a:b][~covered[a:b]]
                kept.append(hashlib.sha256(left.tobytes()).hexdigest() if digest else left.tobytes())
            columns = [pa.array(batch.ids, pa.int64()), pa.array(batch.ends - batch.starts, pa.int64())]
            columns += [pa.array(x[batch.ends] - x[batch.starts], pa.int64()) for x in (removed, spans)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string() if digest else pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup_passages(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (or their sha256, as hex) for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    batches = stored(docs.select("doc_id", "text").mapInArrow(_packed, BATCHES), "batches")
    buckets = 1 + (batches.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES

    def told(asked: DataFrame, widths: tuple[int, ...], name: str) -> DataFrame:
        said = stored(asked.groupBy("bucket").applyInArrow(_judge(widths), SAID), name)
        return said.groupBy("batch").agg(F.collect_list(F.struct("bucket", "said")).alias(name))  # at most one for each bucket

    first = told(batches.mapInArrow(_ask_first(buckets), ASKED), PAIR, "first")
    with_first = batches.join(first, "batch", "left")
    second = told(with_first.mapInArrow(_ask_second(buckets), ASKED), FULL, "second")
    schema = OUT.replace("kept binary", "kept string") if digest else OUT
    return with_first.join(second, "batch", "left").mapInArrow(_cut(buckets, digest), schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")
