"""N-gram Jaccard self-join of documents with signature trees; exact.

A document's set holds its distinct shingles (hashes of ``words`` consecutive words). Two documents
link when the Jaccard similarity of their sets is at least ``percent`` per cent.

1. One pass over the texts gives each row's set size and set hash, and how often shingles fall in
   each slot of a fixed table, which orders shingles from rare to frequent.
2. Sets that can link share some of their rarest shingles: the prefix that leaves less than the needed
   overlap, and one more for every ``EXTRA`` of the set, hold that many more in common. A second pass
   sends the prefixes, once per set and task, to their shingle, in order, where a stream tells the
   shared ones. Shingles of over ``HOT`` of all rows, which the slots show, are dealt to many tasks.
   Only sets with enough shared shingles go on; their shingles are read once more, from rows that a
   bitmap of fixed size names, and written as hashes, in buckets. A shingle's smallest set is its hub.
3. Hubs are compared with the sets that share a shingle with them, as a stream with one set in memory.
   Components of those links are a first labelling: families of near copies mostly end in one.
4. What is left are shared shingles whose sets have several labels. Sets that a chain of those joins are
   a cell if they are few; else each shingle (one for all with the same sets) is a cell, so that common
   lines do not chain the corpus together. In a cell, sets are leaves of a signature tree: nodes hold
   the OR of token bitmaps, the range of sizes and the largest number of tokens beyond one per bit. A
   dual traversal drops node pairs whose largest possible overlap is too small, or that are connected
   already; what remains is counted exactly. Cells beyond ``CELL`` sets or ``CELL_TOKENS`` tokens are
   laid out as a grid of blocks, one task for each pair of blocks with more than one label.

Every pair that links shares a prefix shingle, so it has one label after step 3 or meets in a cell:
no link is lost. A shingle stands in a prefix only of sets that have hardly rarer ones, so a large
cell holds texts that are alike almost throughout.
Exact copies are one set throughout, so a hot text costs no more than a rare one. Hashes have 64
bits; a collision of two sets among a billion has a chance of some 3 per cent.

Defined results: a text with fewer words is one shingle, its whole sequence; null and blank texts
have the empty set and link with nothing, their component is their own doc_id; a component of rows
without doc_id has component null; repeated rows share a component; an empty table gives no rows;
columns other than doc_id and text are ignored; of a text of any length all words count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normata.llm.common import bucketed, discard, materialise, slices
from normata.llm.components import connected_components

WORDS, PERCENT = 5, 80
SLOT_BITS, CHUNKS = 22, 16
#: Share of all rows from which a slot is hot, and the tasks that its tokens are dealt to.
HOT, SALTS = 0.01, 64
#: Shingles of a set for one more in its prefix; bits of the map of chosen rows (8 MB).
EXTRA, MAP_BITS = 40, 26
BITMAP_WORDS = 64  # of 64 bits
CELL, CELL_TOKENS, LEAF, FANOUT = 1500, 4_000_000, 24, 8
ROW_SCHEMA = "key long, doc_id long, n long, set long, chunk int, counts binary"


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are kept for frequent words."""

    LIMIT = 400_000

    def __init__(self, words: int = WORDS):
        self.words, self.cache = words, {}

    def hashes(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
        cache = self.cache
        if len(cache) > self.LIMIT:
            cache.clear()
        for w in found:
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.hashes(text)
        if not len(words):
            return words
        k = min(self.words, len(words))
        m = len(words) - k + 1
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = (h ^ words[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(h ^ h >> np.uint64(32))


def needed(a: int, b: int, percent: int) -> int:
    """Smallest overlap with which sets of ``a`` and ``b`` tokens link."""
    return -(-percent * (a + b) // (100 + percent))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def keyed(documents: DataFrame) -> DataFrame:
    """(key, doc_id, text): the key is a hash of both, so that rows without id have one too."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def describe(documents: DataFrame, words: int) -> DataFrame:
    """A row per document, and per task the slot counts of its shingles in ``CHUNKS`` pieces."""
    names = [part.split()[0] for part in ROW_SCHEMA.split(", ")]

    def batch_of(*columns) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, slots = Shingler(words), np.zeros(1 << SLOT_BITS, np.uint16)
        for batch in slices(batches):
            sizes, ids = [], []
            for text in batch.column("text").to_pylist():
                tokens = shingle(text)
                sizes.append(len(tokens))
                ids.append(set_id(tokens))
                at = slot_of(tokens)
                slots[at] += slots[at] < 65535
            m = len(sizes)
            yield batch_of(batch.column("key"), batch.column("doc_id"), sizes, ids, [-1] * m, [None] * m)  # ids stay as they are
        for i, piece in enumerate(np.split(slots, CHUNKS)):
            yield batch_of([0], [None], [0], [0], [i], [zlib.compress(piece.tobytes(), 1)])

    return keyed(documents).mapInArrow(run, ROW_SCHEMA)


def slot_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def slot_counts(described: DataFrame) -> np.ndarray:
    """Sum of the tasks' slot counts: a table of fixed size (16 MB), so it may be broadcast."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = np.frombuffer(zlib.decompress(counts), np.uint16)
                sums[chunk] = sums.get(chunk, 0) + piece.astype(np.uint64)
        for chunk, total in sums.items():
            packed = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "counts"])

    pieces = described.where("chunk >= 0").select("chunk", "counts").repartition(CHUNKS, "chunk")
    rows = sorted((r.chunk, r.counts) for r in pieces.mapInArrow(add, "chunk int, counts binary").collect())
    if not rows:
        return np.zeros(1 << SLOT_BITS, np.uint32)
    return np.concatenate([np.frombuffer(c, np.uint32) for _, c in rows])


def prefixes(documents: DataFrame, slots: Broadcast, hot: int, words: int, percent: int) -> DataFrame:
    """(token, salt, set): the rarest tokens of each set, of which a set that it links with has ``1 + n // EXTRA``, for the smaller n.

    ``salt`` is 0, but for tokens of a slot with ``hot`` rows or more one of the numbers from 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, counts = Shingler(words), set(), slots.value
        for batch in slices(batches):
            tokens_out, salts_out, sets_out = [], [], []
            for text in batch.column(0).to_pylist():
                tokens = shingle(text)
                n, own = len(tokens), set_id(tokens)
                if not n or own in seen:
                    continue
                seen.add(own)
                length = n - -(-percent * n // 100) + 1 + n // EXTRA
                often = counts[slot_of(tokens)]
                rank = np.lexsort((tokens, often))[:length]
                tokens_out.append(signed(tokens[rank]))
                salts_out.append(np.where(often[rank] >= hot, 1 + own % SALTS, 0).astype(np.int32))
                sets_out.append(np.full(length, own))
            if tokens_out:
                kinds = (pa.int64(), pa.int32(), pa.int64())
                arrays = [pa.array(np.concatenate(x), k) for x, k in zip((tokens_out, salts_out, sets_out), kinds, strict=True)]
                whole = pa.RecordBatch.from_arrays(arrays, ["token", "salt", "set"])
                for at in range(0, len(whole), 100_000):
                    yield whole.slice(at, 100_000)

    return documents.select(F.col("text").cast("string")).mapInArrow(run, "token long, salt int, set long")


def shared_tokens(prefix: DataFrame) -> DataFrame:
    """(token, set): the distinct prefix rows whose token several sets share; of hot tokens, all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None, None)  # token, salt, first set and set of the row before
        for batch in batches:
            token, salt, own = (c.to_numpy() for c in batch.columns)
            if not len(token):
                continue
            begins = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            at = np.maximum.accumulate(np.where(begins, np.arange(len(token)), 0))
            first, before = own[at], np.append(own[0], own[:-1])
            if (token[0], salt[0]) == last[:2]:
                first[at == 0], before[0], begins[0] = last[2], last[3], False
            fresh = begins | (own != before)  # no repeat of the row before
            other = fresh & (own != first) & (salt == 0)
            second = other & (before == first)  # tells that the first one is shared
            kept = other | fresh & (salt != 0)
            arrays = np.append(token[second], token[kept]), np.append(first[second], own[kept])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in arrays], ["token", "set"])
            last = (token[-1], salt[-1], first[-1], own[-1])

    dealt = prefix.repartition("token", "salt").sortWithinPartitions("token", "salt", "set")
    return dealt.mapInArrow(run, "token long, set long")


def meetings(prefix: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(token, set, hub): where sets that may link meet, with the smallest of those."""
    shared = materialise(shared_tokens(prefix), "shared")
    least = 1 + F.floor(F.ceil(percent * F.col("n") / 100) / EXTRA)  # with the smallest set that this one could link with
    enough = shared.groupBy("set").agg(F.count(F.lit(1)).alias("met")).join(sizes, "set").where(F.col("met") >= least).select("set")
    kept = materialise(shared.join(enough, "set"), "kept")
    hubs = kept.groupBy("token").agg(F.min("set").alias("hub"), F.max("set").alias("other")).where("hub <> other")
    met = materialise(kept.join(hubs.select("token", "hub"), "token").select("token", "set", "hub"), "meetings")
    for table in (shared, kept):
        discard(table)
    return met


def key_map(keys: DataFrame) -> np.ndarray:
    """Bits of the keys' low ends: a map of fixed size, which lets through all of them and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << MAP_BITS) // 8, np.uint8)
        for batch in batches:
            place = map_place(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, place >> 3, (128 >> (place & 7)).astype(np.uint8))
        for i, piece in enumerate(np.split(bits, CHUNKS)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)])], ["chunk", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[i] = held.get(i, 0) | np.frombuffer(zlib.decompress(packed), np.uint8)
        for i, piece in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([piece.tobytes()])], ["chunk", "bits"])

    schema = "chunk int, bits binary"
    out = np.zeros((CHUNKS, (1 << MAP_BITS) // 8 // CHUNKS), np.uint8)
    for row in keys.mapInArrow(run, schema).repartition(CHUNKS, "chunk").mapInArrow(merge, schema).toLocalIterator():
        out[row.chunk] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def map_place(keys: np.ndarray) -> np.ndarray:
    return keys & ((1 << MAP_BITS) - 1)


def token_lists(documents: DataFrame, rows: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(set, tokens): the tokens of each of ``sets``, from one stored row for each; no text is shuffled.

    Rows equal in id and text, and rows that the map lets through by chance, may give a set more than once.
    """
    stand = rows.where("n > 0").groupBy("set").agg(F.min("key").alias("key"))
    chosen = documents.sparkSession.sparkContext.broadcast(key_map(stand.join(sets, "set").select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, bits = Shingler(words), set(), chosen.value
        for batch in slices(batches):
            place = map_place(batch.column(0).to_numpy())
            wanted = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            found = {}
            for text in batch.column(1).filter(pa.array(wanted)).to_pylist():
                tokens = shingle(text)
                own = set_id(tokens)
                if len(tokens) and own not in seen:
                    seen.add(own)
                    found[own] = tokens.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int64()), pa.array([*found.values()], pa.binary())], ["set", "tokens"])

    lists = bucketed(keyed(documents).select("key", "text").mapInArrow(run, "set long, tokens binary"), "tokens", "set")
    chosen.destroy()
    return lists


def tokens_from(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def hub_links(met: DataFrame, lists: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set that links with the hub ``a`` of one of its tokens.

    A hub's sets of a size near enough stream by it; those of a hot hub are dealt to several tasks.
    """
    every = met.where("set <> hub").select("hub", "set").distinct().join(sizes, "set").join(sizes.select(F.col("set").alias("hub"), F.col("n").alias("m")), "hub")
    pairs = materialise(every.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("hub", "set"), "pairs")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    near = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "set")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("set"))
    asked = materialise(near.unionByName(hubs), "asked")  # its size is known to the join with the much longer rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            a, b = [], []
            for at, kind, own, packed in zip(*(batch.column(c).to_pylist() for c in ("hub", "kind", "set", "tokens")), strict=True):
                tokens = tokens_from(packed)
                if kind == 0:
                    hub, held = at, tokens
                    continue
                need = needed(len(held), len(tokens), percent)
                if at == hub and min(len(held), len(tokens)) >= need:
                    place = np.minimum(np.searchsorted(held, tokens), len(held) - 1)
                    if int((held[place] == tokens).sum()) >= need:
                        a.append(hub)
                        b.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = lists.join(asked, "set").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return dealt.mapInArrow(run, "a long, b long")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP_WORDS * 64, bool)
    bits[(tokens >> np.uint64(40)).astype(np.int64) % len(bits)] = True
    return np.packbits(bits).view(np.uint64)


class SignatureTree:
    """Nodes over the rows of ``bitmaps``: OR of bitmaps, size range, largest surplus of tokens over bits."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, members: np.ndarray):
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        self.mask, self.low, self.high, self.surplus = [], [], [], []
        surplus = sizes - np.bitwise_count(bitmaps).sum(axis=1)
        level = []
        for at in range(0, len(members), LEAF):
            own = members[at : at + LEAF]
            level.append(self.node([], own, np.bitwise_or.reduce(bitmaps[own]), sizes[own].min(), sizes[own].max(), surplus[own].max()))
        while len(level) > 1:
            level = [self.above(level[at : at + FANOUT]) for at in range(0, len(level), FANOUT)]
        self.root = level[0]

    def node(self, children, members, mask, low, high, surplus) -> int:
        for to, value in zip((self.children, self.members, self.mask, self.low, self.high, self.surplus),
                             (children, members, mask, int(low), int(high), int(surplus)), strict=True):
            to.append(value)
        return len(self.children) - 1

    def above(self, nodes: list[int]) -> int:
        pick = lambda of: [of[n] for n in nodes]
        return self.node(nodes, np.concatenate(pick(self.members)), np.bitwise_or.reduce(np.array(pick(self.mask))),
                         min(pick(self.low)), max(pick(self.high)), max(pick(self.surplus)))

    def can_link(self, a: int, other: SignatureTree, b: int, percent: int) -> bool:
        if 100 * self.high[a] < percent * other.low[b] or 100 * other.high[b] < percent * self.low[a]:
            return False
        most = int(np.bitwise_count(self.mask[a] & other.mask[b]).sum()) + min(self.surplus[a], other.surplus[b])
        return min(most, self.high[a], other.high[b]) >= needed(self.low[a], other.low[b], percent)


def link_groups(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Component (smallest index) of each set, over the links between ``left`` and ``right``; ``labels``: those known."""
    sizes = np.array([len(s) for s in sets])
    bitmaps = np.array([bitmap(s) for s in sets])
    surplus = sizes - np.bitwise_count(bitmaps).sum(axis=1)
    labels = np.arange(len(sets)) if labels is None else labels.copy()

    def join(i: int, js: np.ndarray) -> None:
        old = np.unique(np.append(labels[js], labels[i]))
        labels[np.isin(labels, old)] = old[0]

    def overlap(i: int, js: np.ndarray) -> np.ndarray:
        tokens = np.concatenate([sets[j] for j in js])
        at = np.minimum(np.searchsorted(sets[i], tokens), sizes[i] - 1)
        return np.add.reduceat((sets[i][at] == tokens).astype(np.int64), np.append(0, np.cumsum(sizes[js])[:-1]))

    def compare(i: int, js: np.ndarray) -> None:
        """Count overlaps of ``i`` with those of ``js`` that could link and are not connected yet."""
        js = js[labels[js] != labels[i]]
        if not len(js):
            return
        need = -(-percent * (sizes[js] + sizes[i]) // (100 + percent))
        js, need = js[w := np.minimum(sizes[js], sizes[i]) >= need], need[w]
        most = np.bitwise_count(bitmaps[js] & bitmaps[i]).sum(axis=1) + np.minimum(surplus[js], surplus[i])
        js, need = js[w := most >= need], need[w]
        if len(js) and len(linked := js[overlap(i, js) >= need]):
            join(i, linked)

    self_join = left is right
    if self_join and len(left) > LEAF:  # the set that shares most with all others connects most of a group at once
        tokens, counts = np.unique(np.concatenate([sets[i] for i in left]), return_counts=True)
        share = [counts[np.searchsorted(tokens, sets[i])].sum() for i in left]
        compare(int(left[int(np.argmax(share))]), left)
    order = lambda part: part[np.lexsort((sizes[part], [int(sets[i][0]) for i in part]))]
    a = SignatureTree(bitmaps, sizes, order(left))
    b = a if self_join else SignatureTree(bitmaps, sizes, order(right))
    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        if not a.can_link(x, b, y, percent):
            continue
        both = np.concatenate([a.members[x], b.members[y]])
        if (labels[both] == labels[both[0]]).all():
            continue
        if not a.children[x] and not b.children[y]:
            for i in a.members[x]:
                compare(int(i), b.members[y])
        elif self_join and x == y:
            down = a.children[x]
            stack += [(c, d) for k, c in enumerate(down) for d in down[k:]]
        elif b.children[y] and (not a.children[x] or len(b.members[y]) >= len(a.members[x])):
            stack += [(x, d) for d in b.children[y]]
        else:
            stack += [(c, y) for c in a.children[x]]
    return labels


def cells_of(met: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, low, high, block, set, label): what is left to compare once sets have labels.

    Two sets that share a token were compared if they are all it has, as one is the hub; so an open
    token has three sets or more, and more than one label.
    """
    marked = met.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    by_token = marked.groupBy("token").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("m"), F.min("set").alias("lead"),
        F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("total"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("mix"),
    )
    open_ = materialise(by_token.where("least <> most AND m > 2").drop("least", "most"), "open")
    rest = materialise(marked.join(open_.select("token", "lead"), "token").select("token", "set", "label", "lead"), "rest")
    chains = connected_components(rest.select(F.col("set").alias("a"), F.col("lead").alias("b"))).select(F.col("node").alias("set"), "root")
    members = rest.select("set", "label").distinct().join(chains, "set").join(sizes, "set")
    sized = members.groupBy("root").agg(((F.count(F.lit(1)) <= CELL) & (F.sum("n") <= CELL_TOKENS)).alias("small"))
    found = materialise(members.join(sized, "root"), "chains")
    zero = F.lit(0)
    small = found.where("small").select(F.col("root").alias("cell"), zero.alias("low"), zero.alias("high"), zero.alias("block"), "set", "label")
    # Tokens of the very same sets are one cell.
    one = open_.groupBy("m", "total", "mix").agg(F.min("token").alias("token")).select("token")
    large = rest.select("token", "set", "label").join(found.where("NOT small").select("set", "n"), "set").join(one, "token")
    sums = large.groupBy("token").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("n") / CELL_TOKENS)).cast("int").alias("blocks"))
    large = large.join(sums, "token")
    placed = large.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    pairs = each.select(F.col("token").alias("cell"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set", "label")
    same = pairs.groupBy("cell", "low", "high").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x = y")  # connected throughout
    return small.unionByName(pairs.join(same.select("cell", "low", "high"), ["cell", "low", "high"], "left_anti"))


def verified(cells: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set of a cell with the smallest set that it is connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, met = None, [], set()

        def close() -> pa.RecordBatch:
            a, b = [], []
            if len(held) > 1:
                held.sort(key=lambda x: x[1])
                block, ids, label, sets = (list(x) for x in zip(*held, strict=True))
                first: dict[int, int] = {}
                known = np.array([first.setdefault(x, i) for i, x in enumerate(label)])
                block, every = np.array(block), np.arange(len(ids))
                left, right = (every, every) if cell[1] == cell[2] else (every[block == cell[1]], every[block == cell[2]])
                if len(left) and len(right):
                    labels = link_groups(sets, left, right, percent, known)
                    moved = np.flatnonzero(labels != known)
                    a, b = [ids[i] for i in moved], [ids[labels[i]] for i in moved]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("cell", "low", "high", "block", "set", "label", "tokens"))
            for *at, block, own, label, packed in zip(*columns, strict=True):
                if at != cell:
                    yield close()
                    cell, held, met = at, [], set()
                if own not in met:
                    met.add(own)
                    held.append((block, own, label, tokens_from(packed)))
        yield close()

    dealt = lists.join(cells, "set").repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return dealt.mapInArrow(run, "a long, b long")


def set_labels(documents: DataFrame, rows: DataFrame, slots: np.ndarray, words: int, percent: int) -> DataFrame:
    """(set, label): the component of each set that links with another."""
    shared = documents.sparkSession.sparkContext.broadcast(slots)
    sizes = materialise(rows.where("n > 0").groupBy("set").agg(F.first("n").alias("n")), "sizes")
    met = meetings(prefixes(documents, shared, max(3, int(HOT * rows.count())), words, percent), sizes, percent)
    shared.destroy()
    lists = token_lists(documents, rows, met.select("set").distinct(), words)
    first = materialise(connected_components(hub_links(met, lists, sizes, percent)).select(F.col("node").alias("set"), F.col("root").alias("label")), "labels")
    more = materialise(verified(materialise(cells_of(met, first, sizes), "cells"), lists, percent), "links")
    for table in (met, lists):
        discard(table)
    if more.isEmpty():
        return first
    edges = first.select(F.col("set").alias("a"), F.col("label").alias("b")).unionByName(more)
    return connected_components(edges).select(F.col("node").alias("set"), F.col("root").alias("label"))


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, first): ``first`` marks one row key of each component."""
    described = materialise(describe(documents, words), "sets")
    rows = described.where("chunk < 0").select("key", "doc_id", "n", "set")
    labels = set_labels(documents, rows, slot_counts(described), words, percent)
    named = rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("lead"))
    labelled = named.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min("lead").alias("lead"))
    by_set = labelled.select("set", "label").join(least, "label").select("set", "component_id", F.col("lead.key").alias("lead"))
    full = rows.where("n > 0").join(by_set, "set").select("key", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("key") == F.col("lead")).alias("first"))
    empty = rows.where("n = 0").select("key", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return full.unionByName(empty)


def drop_near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``documents`` with one row of each component: its smallest doc_id."""
    gone = near_duplicates(documents, words, percent).where("NOT first OR n_shingles > 0").groupBy("key").agg(
        F.max("first").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    gone = materialise(gone.where("NOT first OR copies > 1").select("key", "first"), "gone")
    docs = documents.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    kept = docs.join(gone.select(F.col("key").alias("__key")), "__key", "left_anti")
    # Rows that are equal in id and text: one of them stays.
    twice = docs.join(gone.where("first").select(F.col("key").alias("__key")), "__key", "left_semi").dropDuplicates(["__key"])
    return kept.unionByName(twice).drop("__key")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t
), n AS (
  SELECT t.doc_id, count(s.g) AS n FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
