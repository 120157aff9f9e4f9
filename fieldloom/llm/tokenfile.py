"""Token ids as canonical, length-limited Huffman codes with random access.

Texts are encoded with a given tokenizer, an end id is appended to each, and the ids of all
documents, in ascending order of doc_id, are written as segments. A corpus folder holds

* `code`: one row for each id in use, (id, bits): lengths of the canonical code, at most
  max(16, log2(ids) + 1) bits, from counts over the whole corpus (package-merge);
* `segments`: rows (part, at, doc_ids, lengths, checkpoints, payload). Parts are ascending ranges of
  doc_id; `at` is the segment's first token within its part; `payload` has the codes, high bit
  first; `checkpoints` has the bit offset of every BLOCK-th token, so that blocks decode
  independently, here all of a segment at once, by one table lookup a token.

Both are written and read by Spark, so the folder can be in any store that Spark reads.

Defined results: null and empty texts have the end id alone; null ids come first; rows with equal
ids stand next to each other, ordered by a hash of the text; an empty table gives an empty corpus;
further columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import documents, shared_dir, small_batches, stored

END_ID = 2
BLOCK = 256
#: A segment is closed when it has so many tokens; a longer document has one of its own.
SEGMENT = 1 << 18
#: Words kept with their ids by a worker (about 170 bytes each).
CACHE_WORDS = 600_000
#: Characters of text that are encoded at once; a longer text is alone.
PIECE = 2 << 20
MAX_BITS = 16


#: The steps before the model of the tokenizers that `WordEncoder` is right for: white space ends every piece.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class TextEncoder:
    """Encodes whole texts: right for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and how many each has."""
        parts, lengths = [], []
        for text in texts:
            own = self.tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids
            parts.append(np.array([*own, end_id], np.uint32))
            lengths.append(len(own) + 1)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(lengths, np.int64)


#: Letters that no normalisation touches, and ASCII marks and digits: between the two, such a tokenizer always cuts.
LETTER, MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[!-/:-@\\[-`{-~0-9]"


class WordEncoder:
    """Encodes texts word by word: a tokenizer of BY_WORD never joins over white space, so equal words have equal ids.

    The ids of up to CACHE_WORDS words are kept from batch to batch; where they are full, those not met since the last
    time go. New words of LETTERs alone are one piece each, and are encoded many at a time: the ids of a piece end with
    the first that has the tokenizer's end mark.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        mark = json.loads(tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for w, i in tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith(mark)]] = True
        self.special = [str(t) for t in tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _keep(self, live: np.ndarray) -> None:
        """Forgets all words but those of the rows marked."""
        rows, number = np.flatnonzero(live), np.cumsum(live) - 1
        self.known = {w: int(number[r]) for w, r in self.known.items() if live[r]}
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.starts, self.sizes, self.met = ends - sizes, sizes, np.zeros(len(rows), bool)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The row of each of the different words in starts and sizes."""
        find = lambda: np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        rows = find()
        n_new = int((rows < 0).sum())
        if n_new and len(self.known) + n_new > CACHE_WORDS:
            now = np.zeros(len(self.met), bool)
            now[rows[rows >= 0]] = True
            self._keep(self.met | now if np.sum(self.met | now) <= CACHE_WORDS // 2 else now)
            rows = find()
        self.met[rows[rows >= 0]] = True
        if n_new:
            places = np.flatnonzero(rows < 0)
            new = [words[i] for i in places.tolist()]
            plain = np.asarray(pc.match_substring_regex(pa.array(new, pa.large_string()), f"^{LETTER}+$"))
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            places, new = places[order], [new[i] for i in order.tolist()]
            ids, sizes = [], []
            for at in range(0, n_new, 1024):
                part, to = new[at : at + 1024], min(at + 1024, int(plain.sum()))
                flat, own = self._joined(part[: to - at]) if to > at else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                lists = [e.ids for e in self.tokenizer.encode_batch_fast(part[max(to - at, 0) :], add_special_tokens=False)]
                rest = np.fromiter(map(len, lists), np.int64, len(lists))
                ids += [flat, np.fromiter(chain.from_iterable(lists), np.uint32, int(rest.sum()))]
                sizes += [own, rest]
            own = np.concatenate(sizes)
            rows[places] = len(self.sizes) + np.arange(n_new)
            self.known.update(zip(new, rows[places].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(own) - own])
            self.ids, self.sizes, self.met = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, own]), np.concatenate([self.met, np.zeros(n_new, bool)])
        return rows

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words of one piece each, and how many each has."""
        ids = np.array(self.tokenizer.encode("\n".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer doesn't end its pieces as BY_WORD says")
        return ids, np.diff(ends, prepend=0)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Offsets of the texts' words, the words as numbers, and the different words."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        cut = pc.replace_substring_regex(texts, f"({LETTER})({MARK})", "\\1\n\\2")
        for token in self.special:  # these stay in one piece
            cut = pc.if_else(pc.match_substring(texts, token), texts, cut)
        lists = pc.ascii_split_whitespace(cut)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        return offsets - offsets[0], np.asarray(coded.indices).astype(np.int64), coded.dictionary

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and how many each has."""
        offsets, numbers, words = self._words(texts)
        rows = self.rows_of(words.to_numpy(zero_copy_only=False).tolist())[numbers] if len(words) else np.zeros(0, np.int64)
        sizes = self.sizes[rows]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        lengths = upto[offsets[1:]] - upto[offsets[:-1]] + 1
        # Each id's place: its word's first place, and one more for each end id before.
        ends = np.cumsum(lengths) - 1
        out = np.empty(int(lengths.sum()), np.uint32)
        out[ends] = end_id
        inner = np.ones(len(out), bool)
        inner[ends] = False
        source = np.repeat(self.starts[rows] - upto[:-1], sizes) + np.arange(upto[-1])
        out[inner] = self.ids[source]
        return out, lengths


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits by package-merge; 0 where the count is 0."""
    out, used = np.zeros(len(counts), np.uint8), np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    most = max(most, int(len(used) - 1).bit_length() + 1)
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        both = np.concatenate([single, packages])
        merged = np.argsort(both, kind="stable")
        levels.append(merged < len(single))
        both = both[merged]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, lengths = 2 * len(single) - 2, np.zeros(len(single), np.uint8)
    for is_single in reversed(levels):
        n = int(is_single[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id, shorter first, then by id."""
    codes, used = np.zeros(len(lengths), np.uint64), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code = last = 0
    sizes = lengths[order].tolist()
    made = []
    for n in sizes:
        code <<= n - last
        made.append(code)
        code, last = code + 1, n
    codes[order] = made
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids, high bit first, and the bit offset of every BLOCK-th."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    word, over = starts >> 6, (starts & 63) + n - 64
    code = codes[ids]
    high = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.add.reduceat(high, first)
    cross = np.flatnonzero(over > 0)
    out[word[cross] + 1] += code[cross] << (64 - over[cross]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::BLOCK].astype(np.uint32)


class Decoder:
    """A table of all bit strings of the greatest length: the id that each begins with, and its length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = int(lengths.max())
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.ids = np.zeros(1 << self.bits, np.uint32)
        self.sizes = np.ones(1 << self.bits, np.int64)
        runs = (1 << (self.bits - lengths[order].astype(np.int64))).astype(np.int64)
        total = int(runs.sum())
        self.ids[:total], self.sizes[:total] = np.repeat(order, runs), np.repeat(lengths[order].astype(np.int64), runs)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All n ids of a segment; its blocks step together, one lookup a token."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint64)
        wide = (raw[:-4] << 32) | (raw[1:-3] << 24) | (raw[2:-2] << 16) | (raw[3:-1] << 8) | raw[4:]
        at, mask = checkpoints.astype(np.int64), np.uint64((1 << self.bits) - 1)
        out = np.empty((BLOCK, len(at)), np.uint32)
        last = len(wide) - 1
        for step in range(min(BLOCK, n)):
            seen = (wide[np.minimum(at >> 3, last)] >> (40 - self.bits - (at & 7)).astype(np.uint64)) & mask
            out[step] = self.ids[seen]
            at = at + self.sizes[seen]
        return out.T.reshape(-1)[:n]


def _width(encoder: WordEncoder | TextEncoder, end_id: int) -> str:
    """The type in which ids are held between the passes."""
    return "<u2" if max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"


ENCODED = "doc_id long, tie long, n int, width string, packed binary"


@cache
def encoder(path: str) -> WordEncoder | TextEncoder:
    """The encoder of a tokenizer: one for each worker process, whatever tasks it runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    steps = json.loads(own.to_str())
    return WordEncoder(own) if all(steps[k] == v for k, v in BY_WORD.items()) else TextEncoder(own)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most PIECE bytes of text, or of one text."""
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _encode_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        width, pack = _width(own, end_id), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in _pieces(whole):
                ids, sizes = own.encode(batch.column(2), end_id)
                raw, ends = memoryview(ids.astype(width).tobytes()), (np.cumsum(sizes) * int(width[2])).tolist()
                packed = [pack.compress(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array([width] * len(sizes), pa.string()), pa.array(packed, pa.binary())], names=["doc_id", "tie", "n", "width", "packed"])
            pa.default_memory_pool().release_unused()

    return run


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of rows (…, n, width, packed), and how many each has."""
    unpack, sizes = zstandard.ZstdDecompressor(), batch.column("n").to_numpy().astype(np.int64)
    parts = [np.frombuffer(unpack.decompress(x, max_output_size=int(n) * int(w[2])), w) for x, n, w in zip(batch.column("packed").to_pylist(), sizes, batch.column("width").to_pylist(), strict=True)]
    return (np.concatenate(parts) if parts else np.zeros(0)).astype(np.uint32), sizes


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        own = np.bincount(_unpacked(batch)[0])
        counts = np.pad(counts, (0, max(0, len(own) - len(counts))))
        counts[: len(own)] += own
    ids = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(counts[ids], pa.int64())], names=["id", "n"])


SEGMENT_SCHEMA = "part int, at long, doc_ids array<long>, lengths array<int>, checkpoints binary, payload binary"


def _segment_rows(lengths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lengths.value
        codes, part, at = canonical(bits), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            ids, own = np.concatenate(held), np.concatenate(sizes)
            payload, checkpoints = pack(ids, codes, bits)
            row = [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([pa.concat_arrays(docs).to_pylist()], pa.list_(pa.int64())), pa.array([own.tolist()], pa.list_(pa.int32())), pa.array([checkpoints.astype("<u4").tobytes()], pa.binary()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "at", "doc_ids", "lengths", "checkpoints", "payload"])

        for batch in batches:
            done = 0
            ids, own = _unpacked(batch)
            upto = np.concatenate([[0], np.cumsum(own)])
            while done < len(own):
                room = SEGMENT - sum(map(len, held))
                to = max(done + 1, int(np.searchsorted(upto, upto[done] + room, side="right")) - 1)
                held.append(ids[upto[done] : upto[to]])
                docs.append(batch.column(0).slice(done, to - done))
                sizes.append(own[done:to])
                done = to
                if done < len(own) or sum(map(len, held)) >= SEGMENT:
                    yield segment()
                    at += sum(map(len, held))
                    held, docs, sizes = [], [], []
        if held:
            yield segment()

    return run


def write_corpus(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> str:
    """Encodes docs (doc_id, text) into a corpus folder, by default a new one in the shared folder; returns it."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/fieldloom/corpus-{uuid.uuid4().hex}"
    # Texts are encoded once; the ids are kept, packed, until their counts are known.
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    encoded = stored(rows.mapInArrow(_encode_rows(tokenizer, end_id), ENCODED), "encoded")
    counted = encoded.select("n", "width", "packed").mapInArrow(_count_rows, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counted.collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max([end_id, *(r.id for r in found)]) + 1, np.int64)
    counts[[r.id for r in found]] = [r.n for r in found]
    bits = code_lengths(counts)
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id int, bits int").coalesce(1).write.parquet(f"{folder}/code")
    lengths = spark.sparkContext.broadcast(bits)  # bounded by the vocabulary
    ranged = encoded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ranged.mapInArrow(_segment_rows(lengths), SEGMENT_SCHEMA).write.parquet(f"{folder}/segments")
    return folder


DOC_SCHEMA = "part int, at long, doc_id long, n_tokens long, ids_crc32 long"


def _decoded(bits, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(bits.value) if len(bits.value) else None
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.asarray(row["lengths"], np.int64)
                ids = decoder.decode(row["payload"], np.frombuffer(row["checkpoints"], "<u4"), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                pieces = [ids[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(np.full(len(sizes), row["part"]), pa.int32()), pa.array(row["at"] + ends - sizes, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(sizes, pa.int64())]
                columns.append(pa.array([p.tolist() for p in pieces], pa.list_(pa.int32())) if with_ids else pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "doc_id", "n_tokens", "ids" if with_ids else "ids_crc32"])

    return run


def read_corpus(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (or the ids) of every document of a corpus folder, from its files."""
    small_batches(spark)
    code = spark.read.schema("id int, bits int").parquet(f"{folder}/code").collect()  # bounded by the vocabulary
    bits = np.zeros(max([-1, *(r.id for r in code)]) + 1, np.uint8)
    bits[[r.id for r in code]] = [r.bits for r in code]
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/segments")
    totals = segments.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()  # one row for each part
    starts, before = [], 0
    for r in totals:
        starts.append((r.part, before))
        before += r.n
    first = F.broadcast(spark.createDataFrame(starts, "part int, first long"))
    schema = DOC_SCHEMA.replace("ids_crc32 long", "ids array<int>") if with_ids else DOC_SCHEMA
    docs = segments.mapInArrow(_decoded(spark.sparkContext.broadcast(bits), with_ids), schema).join(first, "part")
    return docs.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids" if with_ids else "ids_crc32")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_corpus(spark, write_corpus(documents(spark, sf_dir), vocabulary()))
