"""Near duplicates by Order MinHash and banded alignment (operator 8).

A text is the sequence of its words. Its five-word shingles are labelled with their occurrence, and for each of several
hash functions its sketch is the few smallest labelled shingles in text order. Texts that share a sketch are candidates,
and a banded alignment of their words decides: two texts are linked if the words that they have in common, in order, make
up 0.8 or more of all their words. So few edits, wherever they stand, never part two texts that met.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, release, shared_dir, slices, texts_of
from .components import connected_components

#: Words of a shingle and least similarity of a link.
WORDS = 5
SIMILARITY = 0.8
#: Sketches of a text, and shingles of a sketch: texts whose shingles are alike to the share s (in common of all) share no
#: sketch with a chance of about (1 - s ** 2) ** 20: one in 700 million at 0.8, 0.3 % at 0.5.
BANDS = 20
PICKED = 2
#: Words of a part of the texts to align, on the average: of pairs with leaders, and of a bucket; tasks take two parts at once.
PART_WORDS = 1 << 16
BUCKET_WORDS = 1 << 18
#: Bytes of a text's profile as it is kept, and as it is made within a task, each with the least similarity estimated from
#: two such profiles at which texts are compared further: over four standard deviations below SIMILARITY.
PROFILE, LEAST_ESTIMATE = 128, 0.65
WIDE, LEAST_WIDE = 512, 0.72
#: Half the width of the band that is tried first, and of the widest band whose matches are kept as bits of each word.
NARROW = 32
WIDEST = 1 << 13
#: Slots of the bitmap that tells wanted texts from most others: 1 MB at most, whatever the corpus.
SLOTS = 1 << 23
SLOTS_PER_ROW = 1 << 15  # fixed by bitmap_construct_agg

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[0])[:, None]
_FACTORS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[1])[:, None] | np.uint64(1)
_LAST = np.uint64(2**64 - 1)


def words_of(text: str) -> list[bytes]:
    """Runs of anything but space and \\t to \\r."""
    return text.encode("utf-8", "replace").split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def labelled_shingles(codes: np.ndarray) -> np.ndarray:
    """A number for each shingle of a text of these words, in order; equal shingles get numbers by occurrence, so all
    differ. A text of fewer than WORDS words is one shingle, one without words none."""
    if not len(codes):
        return codes
    n = max(1, len(codes) - WORDS + 1)
    rolled = np.full(n, len(codes) if len(codes) < WORDS else 0, np.uint64)
    for k in range(min(WORDS, len(codes))):
        rolled += codes[k : k + n] * _ODD[k]
    rolled = mix(rolled)
    ranked = np.sort(rolled)
    if (ranked[1:] == ranked[:-1]).any():
        order = np.argsort(rolled, kind="stable")
        rolled[order] = labelled(ranked)
    return rolled


def labelled(ranked: np.ndarray) -> np.ndarray:
    """Of sorted numbers: the first of equal ones as it is, each later one renamed by its occurrence."""
    at = np.arange(len(ranked))
    nth = at - np.maximum.accumulate(np.where(np.r_[False, ranked[1:] == ranked[:-1]], 0, at))
    return np.where(nth > 0, mix(ranked + nth.astype(np.uint64) * _ODD[1]), ranked)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """A signed 64-bit sketch for each band: of the PICKED smallest shingles under its hash, in text order."""
    picked = min(PICKED, len(shingles))
    at = np.empty((BANDS, picked), np.int64)
    step = max(1, (1 << 18) // len(shingles))  # bands at once, so that a long text takes little more memory than itself
    for low in range(0, BANDS, step):
        part = slice(low, min(low + step, BANDS))
        values = (shingles[None, :] ^ _SEEDS[part]) * _FACTORS[part]
        for k in range(picked):
            at[part, k] = values.argmin(1)
            values[np.arange(len(values)), at[part, k]] = _LAST
    at.sort(1)
    out = np.full(BANDS, picked, np.uint64)
    for k in range(picked):
        out = mix(out * _ODD[2] + shingles[at[:, k]])
    return out.view(np.int64)


def labelled_words(codes: np.ndarray) -> np.ndarray:
    """A number for each word, sorted; equal words get numbers by occurrence, so all differ."""
    return np.sort(mix(labelled(np.sort(codes))))


def profile(words: np.ndarray, slots: int = PROFILE) -> np.ndarray:
    """One byte for each of so many ranges of numbers: of the smallest labelled word there, or 0 where there is none."""
    at = np.searchsorted(words, np.arange(slots, dtype=np.uint64) << np.uint64(65 - slots.bit_length()))
    filled = at < np.r_[at[1:], len(words)]
    out = np.zeros(slots, np.uint8)
    out[filled] = 1 + (words[at[filled]] >> np.uint64(24)) % np.uint64(255)
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of profiles: the share of equal bytes where either has one. It estimates the words in common of all words,
    which no alignment exceeds."""
    either = ((a > 0) | (b > 0)).sum(1)
    return ((a == b) & (a > 0)).sum(1) / np.maximum(1, either)


def in_band(a: np.ndarray, b: np.ndarray, left: int, right: int, needed: int) -> int:
    """Longest common subsequence of a and b through positions i of a and j of b with -left <= i - j <= right, by one
    addition of bit vectors as wide as the band for each word of b; stops where `needed` is out of reach.

    Bit p of the vector stands for i = j - left + p and is 0 where the subsequence of the words so far grows by one.
    """
    width = left + right + 1
    everything, top = (1 << width) - 1, 1 << (width - 1)
    state, found = everything, 0
    rows = b.tolist()
    step = max(4 * width, 256) if width <= 2 * NARROW + 1 else max(width, 256)
    for first in range(0, len(rows), step):
        part = rows[first : first + step]
        low = max(0, first - left)
        bits: dict[int, int] = {}
        if width <= 2 * WIDEST:
            for k, x in enumerate(a[low : first + len(part) + right].tolist(), low + left - first):
                bits[x] = bits.get(x, 0) | (1 << k)
        for k, x in enumerate(part):
            if width <= 2 * WIDEST:
                match = (bits.get(x, 0) >> k) & everything
            else:  # a row at a time, in memory of the band's width
                begin = max(0, first + k - left)
                same = np.packbits(a[begin : first + k + right + 1] == np.uint64(x), bitorder="little")
                match = int.from_bytes(same.tobytes(), "little") << (begin - (first + k - left))
            hit = state & match
            state = ((state + hit) | (state - hit)) & everything
            found += not state & 1
            state = (state >> 1) | top
        if found + width - state.bit_count() + len(rows) - first - len(part) < needed:
            return 0
    return found + width - state.bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the words in common, in order, are SIMILARITY of all words of two texts (their word codes).

    Words at both ends that agree are taken off. Paths with enough words in common leave no more than the rest unmatched,
    so they stay in a band about the diagonal; a narrow band is tried first, and the whole of it decides.
    """
    needed = int(np.ceil(SIMILARITY / (1 + SIMILARITY) * (len(a) + len(b)) - 1e-9))
    if not needed or needed > min(len(a), len(b)):
        return False
    for turn in (1, -1):
        short = min(len(a), len(b))
        x, y = a[::turn][:short], b[::turn][:short]
        differ = x != y
        same = int(differ.argmax()) if differ.any() else short
        a, b, needed = (a[same:], b[same:], needed - same) if turn == 1 else (a[: len(a) - same], b[: len(b) - same], needed - same)
    if needed <= 0:
        return True
    if needed > min(len(a), len(b)):
        return False
    left, right = len(b) - needed, len(a) - needed
    if max(left, right) > NARROW and in_band(a, b, min(left, NARROW), min(right, NARROW), needed) >= needed:
        return True
    if left + right > 512 and (Counter(a.tolist()) & Counter(b.tolist())).total() < needed:
        return False
    return in_band(a, b, left, right, needed) >= needed


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, sketches, profile): key names the sequence of words (128 bits), n counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches):
            keys, counts, found, profiles = [], [], [], []
            for text in texts_of(batch):
                words = words_of(text)
                codes = word_codes(words)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                counts.append(len(codes))
                found.append(sketches(labelled_shingles(codes)) if len(codes) else np.zeros(0, np.int64))
                profiles.append(profile(labelled_words(codes)).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": pa.array(keys, pa.binary()), "n": pa.array(counts, pa.int32()), "sketches": pa.array(found, pa.list_(pa.int64())), "profile": pa.array(profiles, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, key binary, n int, sketches array<long>, profile binary")


def buckets(texts: DataFrame) -> DataFrame:
    """(id, n, bucket): where each text meets others, by sketch and size. Texts of sizes within a factor 1 / SIMILARITY share
    a size class: that of log2 n, and the next for those just below it."""
    size = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    classes = F.when(F.col("n") / SIMILARITY >= F.pow(F.lit(2.0), size + 1) - 1e-9, F.array(size, size + 1)).otherwise(F.array(size))
    placed = texts.select("id", "n", F.posexplode("sketches").alias("band", "sketch"), classes.alias("classes")).select("id", "n", "band", "sketch", F.explode("classes").alias("size_class"))
    return placed.select("id", "n", F.xxhash64("band", "size_class", "sketch").alias("bucket"))


def with_company(members: DataFrame) -> DataFrame:
    """(id, n, bucket, weight): members (id, n, bucket) of buckets that hold several ids; a text's weight is the sum of the
    sizes of its buckets, which is largest in the middle of a group."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    shared = members.join(sizes.select("bucket", "size"), "bucket")
    weights = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    return shared.select("id", "n", "bucket").join(weights, "id")


def led(shared: DataFrame) -> DataFrame:
    """(a, b): each member a of the buckets of with_company() with its bucket's leader b, its member of the largest weight.
    As one order of texts decides in all buckets, those of one group draw the same few leaders, near to most of the group."""
    leaders = shared.groupBy("bucket").agg(F.max_by("id", F.struct("weight", F.xxhash64("id"))).alias("leader"))
    return shared.join(leaders, "bucket").where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()


def mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root, bucket, parts): members (id, n, bucket) of buckets that hold several classes, and how many parts of about
    BUCKET_WORDS words a bucket has; roots: (node, root) of linked texts, others being classes of their own."""
    rows = shared.join(roots, shared["id"] == roots["node"], "left").select("id", "n", F.coalesce("root", "id").alias("root"), "bucket")
    several = rows.groupBy("bucket").agg(F.sum("n").alias("words"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    return rows.join(several.select("bucket", F.ceil(F.col("words") / BUCKET_WORDS).cast("int").alias("parts")), "bucket").drop("n")


def likely_among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose id is not among wanted; a filter ahead of a join that shuffles texts.

    A bitmap of the wanted ids' hashes is broadcast; it has SLOTS bits at most, and when too full it only lets more rows
    through to the join.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    bitmap = wanted.select(slot.alias("slot")).groupBy(F.expr(f"slot div {SLOTS_PER_ROW}").alias("part")).agg(F.expr(f"bitmap_construct_agg(slot % {SLOTS_PER_ROW})").alias("bits"))
    placed = rows.withColumn("slot", slot).withColumn("part", F.expr(f"slot div {SLOTS_PER_ROW}"))
    byte = F.expr(f"cast(conv(hex(substr(bits, cast(slot % {SLOTS_PER_ROW} div 8 as int) + 1, 1)), 16, 10) as int)")
    inside = F.call_function("shiftright", byte, F.expr("cast(slot % 8 as int)")).bitwiseAND(F.lit(1)) == 1
    return placed.join(F.broadcast(bitmap), "part").where(inside).select(*rows.columns)


def likely(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose profiles (id, profile) do not rule them out; spares fetching most unlike texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PROFILE) for c in ("profile_a", "profile_b"))
                yield batch.select(["a", "b"]).filter(pa.array(estimates(a, b) >= LEAST_ESTIMATE))

    first = pairs.join(profiles.select(F.col("id").alias("a"), F.col("profile").alias("profile_a")), "a")
    return first.join(profiles.select(F.col("id").alias("b"), F.col("profile").alias("profile_b")), "b").select("a", "b", "profile_a", "profile_b").mapInArrow(run, "a long, b long")


class Union:
    """Roots that have met."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(above, above)
        return x

    def meet(self, x: int, y: int) -> None:
        self.up[self.top(x)] = self.top(y)


def remainder(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among the members (id, root, bucket, parts) of each bucket whose classes differ, enough of them to lead
    wherever all would; docs: (id, text).

    Buckets are cut into their parts; each two parts, and each with itself, are a cell, to which the members' texts are
    sent, and whose pairs one task compares: by wide profiles, then by all their words, then by alignment. Roots that
    already meet are not compared again, so what a cell gives is no more than its members.
    """
    rows = likely_among(docs, members.select("id")).join(members, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "root", "text")
    cell = ["bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for (_, low, high), table in cells(batches, cell):
            links += cell_links(*(table.column(c).to_pylist() for c in ("part", "id", "root", "text")), low, high)
            if len(links) >= 10_000:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]})
                links = []
        if links:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]})

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long")


def cell_links(parts: list[int], ids: list[int], roots: list[int], texts: list[str], low: int, high: int) -> list[tuple[int, int]]:
    """Links between members of the parts low and high of a bucket (of one part, where these are the same)."""
    seen, own, codes, words = set(), [], [], []
    for k, text in enumerate(texts):
        found = word_codes(words_of(text))
        if (key := (ids[k], found.tobytes())) not in seen:  # a row may be repeated
            seen.add(key)
            own.append(k)
            codes.append(found)
            words.append(labelled_words(found))
    profiles = np.array([profile(w, WIDE) for w in words]).reshape(-1, WIDE)
    root, part = np.array([roots[k] for k in own], np.int64), np.array([parts[k] for k in own])
    left, right = (np.arange(len(own)),) * 2 if low == high else (np.flatnonzero(part == low), np.flatnonzero(part == high))
    met, links = Union(), []
    step = max(1, 2048 // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = (x.ravel() for x in np.meshgrid(left[at : at + step], right, indexing="ij"))
        apart = (root[i] != root[j]) & ((i < j) | (low < high))
        i, j = i[apart], j[apart]
        close = estimates(profiles[i], profiles[j]) >= LEAST_WIDE
        for x, y in zip(i[close].tolist(), j[close].tolist()):
            if met.top(int(root[x])) != met.top(int(root[y])) and enough_words(words[x], words[y]) and similar(codes[x], codes[y]):
                met.meet(int(root[x]), int(root[y]))
                links.append((ids[own[x]], ids[own[y]]))
    return links


def enough_words(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the labelled words in common, in any order, are as many as similar() asks for."""
    m = len(np.intersect1d(a, b, assume_unique=True))
    return m >= SIMILARITY * (len(a) + len(b) - m) - 1e-9


def cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each value of the named columns, by which the batches are sorted."""
    kept: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy() for c in names]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(int(v[begin]) for v in values)
            if kept and key != now:
                yield now, pa.Table.from_batches(kept)
                kept = []
            now = key
            kept.append(batch.slice(begin, end - begin))
    if kept:
        yield now, pa.Table.from_batches(kept)


def verify(pairs: DataFrame, docs: DataFrame, mean: float) -> DataFrame:
    """Links (a, b) among pairs (a, b) whose texts, among docs (id, text), are similar; enough of them to lead wherever all
    would, as texts that already meet are not aligned again.

    Texts are dealt into parts of about PART_WORDS, were there a text for each pair (mean: words of a text), and a text is sent once to each cell of two
    parts in which it has a pair, not once for each pair. Of an id with several texts, any that is similar links it.
    """
    parts = max(1, int(pairs.count() * mean / PART_WORDS))
    part = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit("cell")), F.lit(parts))
    placed = pairs.withColumn("cell", part("a") * parts + part("b"))
    wanted = placed.select("cell", F.col("a").alias("id")).union(placed.select("cell", F.col("b").alias("id"))).distinct()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    texts = likely_among(docs, ids).join(wanted, "id")
    none = F.lit(None).cast("long")
    rows = texts.select("cell", F.lit(0).alias("kind"), F.col("id").alias("a"), none.alias("b"), "text")
    rows = rows.unionByName(placed.select("cell", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, met = None, {}, Union()
        for batch in slices(batches):
            links = []
            for cell, kind, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("cell", "kind", "a", "b", "text"))):
                if cell != now:
                    now, codes, met = cell, {}, Union()
                if kind == 0:
                    own = word_codes(words_of(text))
                    codes.setdefault(a, {})[own.tobytes()] = own
                elif met.top(a) != met.top(b) and any(similar(s, t) for s in codes[a].values() for t in codes[b].values()):
                    met.meet(a, b)
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]})

    return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_of) of each row: class_id is the smallest doc_id that chains of links lead to, copy_of the
    smallest with the same words in the same order. docs: doc_id and text, other columns are left out.

    Equal texts (also null and empty ones, which have no words) are one text throughout. Of the buckets of sketches only
    those with several texts are kept. In each the texts are first compared with a leader, which links most of a group.
    This only saves work: then all pairs that share a bucket and are still in different classes are compared (remainder),
    so the classes do not depend on leaders. Rows with equal ids are classed by their texts, and the texts of one id count
    as linked. A row without an id gets the class of its copies that have one, else null; it links nothing. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = signatures(docs).checkpoint()
    copies = rows.groupBy("key").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "sketches", "profile"))).checkpoint()
    texts = copies.where("id is not null and n > 0")
    profiles = texts.select("id", "profile")
    full = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    mean = texts.agg(F.avg("n")).first()[0] or 1.0

    shared = with_company(buckets(texts)).checkpoint()
    links = verify(likely(led(shared), profiles).checkpoint(), full, mean).checkpoint()
    rest = remainder(mixed(shared, connected_components(links)).checkpoint(), full)
    roots = connected_components(links.union(rest))
    release(spark)
    classes = copies.select("key", F.col("id").alias("copy_of")).join(roots, F.col("copy_of") == F.col("node"), "left").select("key", "copy_of", F.coalesce("root", "copy_of").alias("class_id"))
    return rows.select("doc_id", "key").join(classes, "key").select("doc_id", "class_id", "copy_of")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that of its smallest doc_id; of rows with equal ids that with the smallest text stays
    (then of the smallest hash of all columns). Rows without an id stay. All columns are kept."""
    first = near_duplicates(docs).where("doc_id = class_id").select(F.col("doc_id").alias("__first")).distinct()
    kept = docs.join(first, docs["doc_id"] == first["__first"], "left_semi")
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = kept.groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct("text", F.xxhash64(*(F.col(f"`{c}`") for c in hashed)))).alias("__row"))
    return one.select("__row.*").unionByName(docs.where(F.col("doc_id").isNull()))
