"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set is its distinct `size`-word shingles (words lower-cased, A-Z). Its signature has
COORDINATES coordinates, each made of DEPTH minwise values; equal sets are one class, and each
class posts its first document under every coordinate-value pair. Two sets of Jaccard similarity
0.8 agree in a coordinate with probability 0.512; fewer than LEAST of 24 agreements happen to one
such pair in a million.

Lists of postings are never expanded into all their pairs. A round links each member of a list to
one leader (star), confirms these links on the full sets, and joins components. The first leaders
are the members with the longest lists, as the original of a group of copies has; later ones are
drawn by hash. After ROUNDS rounds few lists still span several components, and for those alone the
members outside of the list's largest component are compared with all others: a pair is tested in
the first list that it shares, if it agrees in LEAST coordinates or more, and confirmed likewise
(long lists in blocks, in place, so that only links leave them).
Pairs of one component need no test, so no link between components is lost. Cells of four bits from
each of FUNCTIONS minwise values drop unlike pairs early.

Defined results: null and empty texts, and texts without words, have empty sets and are linked
with nothing; a text of fewer than `size` words has one shingle; rows that share an id count as one
document; rows without id are kept, without component; an empty table gives an empty result;
further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, documents, hashed_windows, short_reads, small_batches, split_words, stored

COORDINATES, DEPTH, LEAST, ROUNDS = 24, 3, 2, 2
#: Of 128 cells, sets of similarity 0.8 differ in 24 on average; in more than MOST_CELLS in one of a million pairs.
FUNCTIONS, MOST_CELLS = 128, 46
#: Lists of more members are compared in blocks of BLOCK; sets of more than HELD_SHINGLES are confirmed apart.
BLOCK_FROM, BLOCK, HELD_SHINGLES = 64, 2048, 2000
#: Ids are broadcast up to this many (8 bytes each), and joined by shuffle beyond.
BROADCAST_IDS = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the row of each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words), np.uint64, len(words))  # bytes.lower() changes A-Z alone
    numbers = np.asarray(coded.indices).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if b"" in words:
        real = numbers != words.index(b"")
        numbers, row = numbers[real], row[real]
    h = hashes[numbers] if len(numbers) else np.zeros(0, np.uint64)
    n_words = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    left = n_words[row] - (np.arange(len(row)) - first[row])  # words from here to the text's end
    s = h.copy()
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    for k in range(1, size):
        s = np.where(left > k, mixed(s * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(h)]), s)
    keep = (left >= size) | ((n_words[row] < size) & (left == n_words[row]))
    s, row = mixed(s[keep]), row[keep]
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], row[new]


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


SIGNED = "doc_id long, n_shingles long, set_key binary, keys array<long>, cells array<long>"


def _sign_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers(FUNCTIONS)
        for batch in batches:
            s, row = shingle_sets(batch.column(1), size)
            n = np.bincount(row, minlength=batch.num_rows)
            full = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            least = lambda f, s=s, starts=starts: mixed(np.minimum.reduceat(s * f, starts)) if len(starts) else np.zeros(0, np.uint64)
            keys = np.zeros((batch.num_rows, COORDINATES), np.uint64)
            cells = np.zeros((batch.num_rows, FUNCTIONS // 16), np.uint64)
            for f in range(FUNCTIONS):
                low = least(factors[f])
                cells[full, f // 16] |= (low & np.uint64(15)) << np.uint64(4 * (f % 16))
                if (c := f // DEPTH) < COORDINATES:
                    value = mixed((np.full(len(full), c + 1, np.uint64) if f % DEPTH == 0 else value) * np.uint64(31) + low)
                    keys[full, c] = value
            sums = [np.zeros(batch.num_rows, np.uint64) for _ in range(2)]
            if len(full):
                sums[0][full], sums[1][full] = np.add.reduceat(mixed(s ^ np.uint64(0xA5A5)), starts), np.add.reduceat(mixed(s * np.uint64(3)), starts)
            raw = np.stack(sums, axis=1).astype("<u8").tobytes()
            set_keys = [raw[16 * i : 16 * i + 16] if n[i] else None for i in range(batch.num_rows)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * x.shape[1], pa.int32()), pa.array(x.view(np.int64).ravel())) for x in (keys, cells)]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(set_keys, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "keys", "cells"])

    return run


def with_ids(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows of docs whose doc_id is among the n distinct ids."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi")


class Sets:
    """Full shingle sets of the documents that were needed so far, as written tables."""

    def __init__(self, docs: DataFrame, size: int):
        self.docs, self.size, self.parts = docs, size, []

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def need(self, pairs: DataFrame) -> None:
        """Makes the sets of documents of these pairs that there are none of yet."""
        self.need_ids(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))

    def need_ids(self, ids: DataFrame) -> None:
        ids = ids.distinct()
        if self.parts:
            ids = ids.join(self.table().select("doc_id"), "doc_id", "left_anti")
        ids = stored(ids, "ids")
        if not (n := ids.count()):
            return
        texts = with_ids(self.docs.select("doc_id", "text"), ids, n).select("doc_id", split_words(ascii_lower(F.col("text"))).alias("words"))
        # Texts of few words have one shingle, the hash of all their words.
        whole = F.array(F.xxhash64(F.array_join("words", " ")))
        sets = hashed_windows(texts, "words", self.size, "w")
        sets = sets.select("doc_id", F.when(F.size("words") < self.size, whole).otherwise(F.array_distinct("w")).alias("shingles"))
        self.parts.append(stored(sets.dropDuplicates(["doc_id"]), "sets"))


def confirmed(pairs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    sets.need(pairs)
    if not sets.parts:
        return pairs.where("false")
    table = sets.table()
    both = pairs.join(table.withColumnsRenamed({"doc_id": "a", "shingles": "x"}), "a").join(table.withColumnsRenamed({"doc_id": "b", "shingles": "y"}), "b")
    # Sets of very different sizes can't be that similar.
    most, least = F.greatest(F.size("x"), F.size("y")), F.least(F.size("x"), F.size("y"))
    common = F.size(F.array_intersect("x", "y"))
    near = F.when(100 * least < percent * most, False).otherwise(100 * common >= percent * (F.size("x") + F.size("y") - common))
    return both.where(near).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest id reachable, for each id of links (a, b), by large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(60):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(new, "edges")
        stars = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("u"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        hubs = new.select(F.col("v").alias("u")).distinct().join(new.select("u"), "u", "left_semi").limit(1).count()
        edges = new
        if stars.n == stars.u and not hubs:  # every id points to one that points nowhere
            break
    leaves = edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct())


def alike(x: str, y: str) -> Column:
    """Whether two signatures differ in few enough cells to be worth a test."""
    differing = F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))
    spread = lambda z: z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
    ones = F.lit(0x1111111111111111)
    return F.aggregate(differing, F.lit(0), lambda n, z: n + F.bit_count(spread(z).bitwiseAND(ones))) <= MOST_CELLS


def _labelled(posts: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return posts.withColumn("component", F.col("doc"))
    return posts.join(found.withColumnRenamed("doc_id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _short_list_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of unlike components from lists of at most BLOCK_FROM members."""
    outside = lists.where("component <> top").select("key", F.col("doc").alias("x"), F.col("cells").alias("x_cells"), F.col("keys").alias("x_keys"), F.col("component").alias("x_component"))
    agreed = F.zip_with("keys", "x_keys", lambda a, b: a == b)
    # One list gives a pair, the first that it shares; outside of the largest component a pair stands on both sides, and counts once.
    once = (F.array_position(agreed, True) == F.col("c") + 1) & ((F.col("component") == F.col("top")) | (F.col("x") < F.col("doc")))
    likely = (F.size(F.filter(agreed, lambda e: e)) >= LEAST) & alike("cells", "x_cells")
    pairs = lists.join(outside, "key").where((F.col("component") != F.col("x_component")) & once & likely)
    return pairs.select(F.least("doc", "x").alias("a"), F.greatest("doc", "x").alias("b"))


def _long_list_pairs(lists: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The same from longer lists: (a, b, sure), sure links where both sets are at hand.

    Blocks of BLOCK outsiders meet blocks of BLOCK members, so no task holds more, and only links
    leave it.
    """
    sets.need_ids(lists.select(F.col("doc").alias("doc_id")))
    if not sets.parts:
        return lists.select(F.col("doc").alias("a"), F.col("doc").alias("b"), F.lit(False).alias("sure")).where("false")
    own = sets.table().select(F.col("doc_id").alias("doc"), F.when(F.size("shingles") <= HELD_SHINGLES, F.col("shingles")).alias("shingles"))
    rows = lists.join(own, "doc").withColumns({"n_m": F.ceil(F.col("n") / BLOCK).cast("int"), "n_x": F.ceil(F.col("n_outside") / BLOCK).cast("int")})
    spot = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    keep = ("key", "c", "doc", "component", "top", "keys", "cells", "shingles")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    members = rows.select(*keep, F.lit(False).alias("out"), spot(F.col("n_m")).alias("i"), F.explode_outer(every("n_x")).alias("j"))
    outside = rows.where("component <> top").select(*keep, F.lit(True).alias("out"), F.explode_outer(every("n_m")).alias("i"), spot(F.col("n_x")).alias("j"))
    return members.unionByName(outside).groupBy("key", "i", "j").applyInArrow(_block_links(percent), "a long, b long, sure boolean")


def _numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for equal values, in 32 bits, and how many there are: as np.unique, in half its memory."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.zeros(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    del ranked
    codes = np.empty(len(values), np.int32)
    codes[order] = np.cumsum(new, dtype=np.int32)
    return codes, int(new.sum()) + (len(values) > 0)


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        out = np.asarray(table.column("out").combine_chunks())
        of = lambda name, width: np.asarray(table.column(name).combine_chunks().flatten()).reshape(-1, width)
        doc, component, top, at = (table.column(k).to_numpy() for k in ("doc", "component", "top", "c"))
        keys, cells = of("keys", COORDINATES), of("cells", FUNCTIONS // 16).view(np.uint64)
        held = table.column("shingles").combine_chunks()
        has, sizes = np.asarray(held.is_valid()), np.asarray(pc.fill_null(pc.list_value_length(held), 0)).astype(np.int64)
        codes, known = _numbered(np.asarray(held.flatten()))
        # Counts are sizes of sets at most, HELD_SHINGLES, and fit 16 bits.
        m, mark, ones = np.flatnonzero(~out), np.zeros(known + 1, np.int16), np.uint64(0x1111111111111111)
        # Members' codes, each list closed by a code that none has, so that empty ones count 0.
        closed = np.insert(codes, np.cumsum(sizes), known) if len(doc) else codes
        del codes, held
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        a, b, sure = [], [], []
        c = int(at[0])
        for x in np.flatnonzero(out):
            same = keys[m] == keys[x]
            good = (component[m] != component[x]) & ((component[m] == top[x]) | (doc[x] < doc[m])) & ~same[:, :c].any(axis=1) & (same.sum(axis=1) >= LEAST)
            i = m[good]
            if len(i):
                z = cells[i] ^ cells[x]
                z |= (z >> np.uint64(1)) | (z >> np.uint64(2)) | (z >> np.uint64(3))
                i = i[np.bitwise_count(z & ones).sum(axis=1) <= MOST_CELLS]
            if not len(i):
                continue
            tested = has[i] & has[x]
            if tested.any():
                own = closed[starts[x] : starts[x] + sizes[x]]
                mark[own] = 1
                common = np.add.reduceat(mark[closed], starts, dtype=np.int16)[i].astype(np.int64)
                mark[own] = 0
                i = i[~tested | (100 * common >= percent * (sizes[i] + sizes[x] - common))]
            a.append(np.minimum(doc[i], doc[x]))
            b.append(np.maximum(doc[i], doc[x]))
            sure.append(has[i] & has[x])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"a": join(a, pa.int64()), "b": join(b, pa.int64()), "sure": join(sure, pa.bool_())})

    return run


def near_groups(docs: DataFrame, size: int, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession, size="1m")
    with short_reads(docs.sparkSession):
        return _near_groups(docs, size, percent)


def _near_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    signed = stored(docs.select("doc_id", "text").mapInArrow(_sign_batches(size), SIGNED), "signed")
    named = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "cells", "keys")).alias("r")).select("set_key", "r.*")
    classes = stored(classes, "classes")
    signatures = classes.select(F.col("doc_id").alias("doc"), "keys", "cells")

    posts = classes.select(F.col("doc_id").alias("doc"), F.posexplode_outer("keys").alias("c", "key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posts = stored(posts.join(shared, "key"), "posts")
    weights = posts.groupBy("doc").agg(F.sum("n").alias("weight"))
    posts = stored(posts.drop("n").join(weights, "doc"), "posts")

    sets, links, found = Sets(docs, size), [], None
    # Rows that share an id are one document, whatever their texts.
    for turn in range(ROUNDS):
        own = _labelled(posts, found)
        order = F.xxhash64("doc", F.lit(turn)) if turn else -F.col("weight")
        leaders = own.groupBy("key").agg(F.min(F.struct(order.alias("o"), "doc", "component")).alias("l"), F.min("component").alias("x"), F.max("component").alias("y"))
        leaders = leaders.where("x <> y").select("key", F.col("l.doc").alias("leader"), F.col("l.component").alias("their_component"))
        stars = own.join(leaders, "key").where(F.col("component") != F.col("their_component"))
        pairs = stars.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()
        cells = lambda of, to: signatures.select(F.col("doc").alias(of), F.col("cells").alias(to))
        pairs = pairs.join(cells("a", "x"), "a").join(cells("b", "y"), "b").where(alike("x", "y")).select("a", "b")
        new = stored(confirmed(stored(pairs, "pairs"), sets, percent), "links")
        if new.isEmpty():
            break
        links.append(new)
        found = stored(components(reduce(DataFrame.unionByName, links)), "components")

    # What is left: lists over several components.
    own = _labelled(posts.drop("weight"), found)
    sizes = own.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 1").select("key", "n", F.col("top.component").alias("top"), (F.col("n") - F.col("top.n")).alias("n_outside"))
    open_lists = stored(own.join(largest, "key").join(signatures, "doc"), "open")
    short, long = open_lists.where(F.col("n") <= BLOCK_FROM), open_lists.where(F.col("n") > BLOCK_FROM)
    pairs = stored(_short_list_pairs(short).withColumn("sure", F.lit(False)).unionByName(_long_list_pairs(long, sets, percent)), "pairs")
    new = pairs.where("sure").select("a", "b").unionByName(confirmed(pairs.where("NOT sure").select("a", "b"), sets, percent))
    new = stored(new, "links")
    if not new.isEmpty():
        links.append(new)
        found = stored(components(reduce(DataFrame.unionByName, links)), "components")

    groups = classes.select("set_key", F.col("doc_id").alias("r"))
    if found is not None:
        groups = groups.join(found.withColumnRenamed("doc_id", "r"), "r", "left")
        groups = groups.select("set_key", F.coalesce("component", "r").alias("component_id"))
    else:
        groups = groups.withColumnRenamed("r", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_key").join(groups, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), 2)


SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS g
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  WITH RECURSIVE t(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, t.c FROM t JOIN e ON t.doc_id = e.a WHERE t.c < e.b)
  SELECT doc_id, min(c) AS component_id FROM t GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM r LEFT JOIN n USING (doc_id)
"""
