"""Near-duplicate join on shingle sets by prefixes under several global orders.

The set of a text holds its different shingles as 64-bit hashes. Two sets
link when their Jaccard similarity reaches ``percent``. Such sets of sizes up
to n have at least ``percent`` % of n shingles in common, so under *any* order
of all shingles the first n - that many + 1 of each, its prefix, have one in
common. Candidates are pairs whose prefixes meet under each of these orders:

0. shingles of one slice of the hash space that no other set has, then all
   others. Counted over all sets. A set with that many such shingles meets no
   other and is done; in ordinary text these are nearly all.
1. the rarest first: an inverted index over these prefixes gives the pairs.
2. and 3. the rarest of one half of the hash space first, then the rest; other
   halves for each. A pair must meet under these too before it is verified.

Sizes and 256 parities of a set, which can't differ in more places than the sets in shingles, thin out
the pairs of an entry first.

Equal sets are one set throughout, however many texts have them. What is
asked for is classes of links, so dense groups needn't be compared pair by
pair: in the first rounds all sets of an index entry are compared to one of
them, a hub. Then only entries that still hold several classes are joined, and
there only pairs of different classes. Every link between two classes is
found; a pair within a class isn't compared, as it can't change anything.

Results for odd input: a null or empty text has an empty set and links with
nothing; one of fewer words than a shingle has one shingle, all its words.
Rows that repeat an id are rows of their own; a null id names a component only
if it has no other. Very long texts are hashed in one block of their own. An
empty table gives no rows. Only the id and the text are read, so other columns
can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.simhash import components
from pagemill.llm.store import BLOCK_BYTES, in_blocks, shared_dir, text_bytes, written

SHINGLE_WORDS = 3
PERCENT = 90
#: Sixteenths of the hash space whose shingles are counted for order 0.
SLICE = 3
#: Rounds in which the sets of an index entry are compared to a hub only.
HUB_ROUNDS = 2
#: Keys of sets that a task may be sent with its code; more are joined by a shuffle.
SENT_ROWS = 200_000

_SPACE = np.zeros(256, bool)
_SPACE[0x20] = _SPACE[0x09:0x0E] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


_BITS = ["bits0", "bits1", "bits2", "bits3"]

# -- sets -----------------------------------------------------------------------------------------

_BASE = 0x9FB21C651E98DF25  # odd, so that it has an inverse among 64-bit numbers
_powers: dict[int, np.ndarray] = {}


def _power_rows(size: int) -> np.ndarray:
    """Powers of the base and of its inverse, for places below ``size`` at least."""
    known = next(iter(_powers.values()), np.zeros((2, 0), np.uint64))
    if known.shape[1] < size:
        _powers.clear()
        known = np.array([_BASE, pow(_BASE, -1, 1 << 64)], np.uint64).repeat(max(size, 1 << 16)).reshape(2, -1)
        known[:, 0] = 1
        np.cumprod(known, axis=1, out=known)
        if size <= 2 * BLOCK_BYTES:
            _powers[size] = known
    return known


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and how many words each text has."""
    data, offsets = text_bytes(column)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    first[borders] = inside[borders]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    letters = _LOWER[data[inside]]
    up, down = _power_rows(len(letters) + 1)
    # a polynomial over the bytes of a word: the difference of two running sums, shifted to the word's first byte
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum((letters + np.uint64(1)) * up[:len(letters)], out=sums[1:])
    hashes = (sums[places[1:]] - sums[places[:-1]]) * down[places[:-1]]
    return _mixed(hashes + np.diff(places).astype(np.uint64)), np.diff(np.searchsorted(starts, offsets))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words, of fewer words for all of them."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i:i + len(out)])
    return out


def shingle_sets(column: pa.Array, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted set of every text."""
    hashes, counts = word_hashes(column)
    runs = shingles(hashes, size)  # of all texts at once; runs over a border are left out
    ends = np.cumsum(counts)
    for end, count in zip(ends.tolist(), counts.tolist()):
        found = np.sort(runs[end - count:end - size + 1]) if count >= size else shingles(hashes[end - count:end], size)
        yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def parities(tokens: np.ndarray) -> bytes:
    """256 bits, each whether an odd number of the set's shingles falls to it: sets differ in as many shingles as bits at least."""
    return np.packbits(np.bincount((tokens & np.uint64(255)).astype(np.int64), minlength=256) & 1).tobytes()


def _lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))


def set_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """id, key (of id and text), n (size of the set), digest of the set, and its shingles of the slice that order 0 counts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            sizes, digests, parts = [], [], []
            for tokens in shingle_sets(batch.column("text"), size):
                sizes.append(len(tokens))
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest())
                parts.append(tokens[:np.searchsorted(tokens, np.uint64(SLICE << 60))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()),
                                              pa.array(digests, pa.string()), _lists(parts)], names=["id", "key", "n", "digest", "slice"])

    rows = docs.select(F.col(id_col).alias("id"), _key(F.col(id_col), F.col(text_col)).alias("key"),
                       F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([rows.schema["id"], rows.schema["key"], T.StructField("n", T.LongType()), T.StructField("digest", T.StringType()),
                         T.StructField("slice", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(work, kind)


def _key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def _prefix_size(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100).cast("long") + 1


# -- orders ---------------------------------------------------------------------------------------

def set_classes(rows: DataFrame, percent: int, folder: str) -> DataFrame:
    """One row for each different set: number c, digest, n, least id, a row's key, and whether order 0 leaves it open."""
    mark = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    owners = rows.select(mark.alias("mark"), F.explode("slice").alias("token")).groupBy("token").agg(F.min("mark").alias("a"), F.max("mark").alias("b"))
    alone = owners.where("a = b").groupBy(F.col("a").alias("mark")).agg(F.count("*").alias("alone"))
    sets = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "key")).alias("r"), F.min("n").alias("n"))
    sets = sets.select("digest", "n", "r.id", "r.key", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("mark"))
    # a set can't reach the similarity with another that lacks or adds one shingle only, if it is too small
    is_open = (F.col("n") * (100 - percent) >= percent) & (F.coalesce("alone", F.lit(0)) < _prefix_size(F.col("n"), percent))
    found = sets.join(alone, "mark", "left").select(F.monotonically_increasing_id().alias("c"), "digest", "n", "id", "key", is_open.alias("open"))
    return written(found, f"{folder}/classes")


def open_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int, folder: str) -> DataFrame:
    """c, n, parities and the whole set of each class that order 0 leaves open."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), size))
            bits = np.frombuffer(b"".join(map(parities, sets)), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([len(s) for s in sets], pa.int64()),
                                              *(pa.array(np.ascontiguousarray(b)) for b in bits.T), _lists(sets)],
                                             names=["c", "n", *_BITS, "tokens"])

    wanted = classes.where("open").select("c", "key")
    count = wanted.count()
    texts = docs.select(_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(wanted) if count <= SENT_ROWS else wanted, "key").select("c", "text")
    found = written(texts.mapInArrow(work, f"c long, n long, {', '.join(f'{b} long' for b in _BITS)}, tokens array<long>"), f"{folder}/open")
    if found.count() != count:  # rows that repeat both id and text
        found = written(found.dropDuplicates(["c"]), f"{folder}/open-once")
    return found


def prefixes(sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """c, n, own (shingles that no other open set has), parities, and the prefixes p1, p2, p3 of each set under orders 1 to 3 without those."""
    each = sets.select("c", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = each.join(shared, "token").groupBy("c").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    in_half = lambda bit: lambda token: F.shiftright(token, bit).bitwiseAND(F.lit(1)) == 0
    rows = sets.select("c", "n", *_BITS, _prefix_size(F.col("n"), percent).alias("p"),
                       *(F.size(F.filter("tokens", in_half(bit))).alias(f"half{bit}") for bit in (0, 1)))
    rows = rows.join(known, "c").withColumn("shared", F.sort_array("shared"))

    def first(pool: Column, room: Column) -> Column:
        return F.slice(pool, F.lit(1), F.greatest(F.lit(0), F.least(room, F.size(pool))).cast("int"))

    def by_half(bit: int) -> Column:
        """The shingles of a half of the hash space before the others, both the rarest first."""
        inside = F.filter("shared", lambda x: in_half(bit)(x["token"]))
        outside = F.filter("shared", lambda x: ~in_half(bit)(x["token"]))
        room = F.col("p") - (F.col(f"half{bit}") - F.size(inside))
        rest = room - F.size(inside) - (F.col("n") - F.col(f"half{bit}") - F.size(outside))
        return F.concat(first(inside, room), first(outside, rest))

    lists = {"p1": first(F.col("shared"), F.col("p") - (F.col("n") - F.size("shared"))), "p2": by_half(0), "p3": by_half(1)}
    rows = rows.select("c", "n", (F.col("n") - F.size("shared")).alias("own"), *_BITS, *(F.transform(v, lambda x: x["token"]).alias(k) for k, v in lists.items()))
    return written(rows.where((F.size("p1") > 0) & (F.size("p2") > 0) & (F.size("p3") > 0)), f"{folder}/prefixes")


# -- candidates and links -------------------------------------------------------------------------

def _may_link(x: str, y: str, percent: int) -> Column:
    """What sizes, own shingles and parities leave possible; the columns' names end in x and y."""
    at = lambda name, side: F.col(f"{name}{side}")
    both = at("n", x) + at("n", y)
    common = F.least(at("n", x) - at("own", x), at("n", y) - at("own", y))
    apart = sum((F.bit_count(at(b, x).bitwiseXOR(at(b, y))) for b in _BITS[1:]), F.bit_count(at(_BITS[0], x).bitwiseXOR(at(_BITS[0], y))))
    return ((100 * F.least(at("n", x), at("n", y)) >= percent * F.greatest(at("n", x), at("n", y)))
            & (100 * common >= percent * (both - common)) & ((100 + percent) * apart <= (100 - percent) * both))


def verified(pairs: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that also meet under orders 2 and 3 and are similar enough."""
    for side in "ab":
        pairs = pairs.join(heads.select(F.col("c").alias(side), F.col("p2").alias(f"p2{side}"), F.col("p3").alias(f"p3{side}")), side)
    pairs = pairs.where(F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b")).select("a", "b")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("c").alias(side), F.col("tokens").alias(f"t{side}")), side)
    common = F.size(F.array_intersect("ta", "tb"))
    return pairs.where(100 * common >= percent * (F.size("ta") + F.size("tb") - common)).select("a", "b")


def linked_classes(sets: DataFrame, heads: DataFrame, percent: int, folder: str) -> DataFrame:
    """node, root for every set that has a link; the roots tell the classes apart."""
    known = ["c", "n", "own", *_BITS]
    entries = written(heads.select(F.explode("p1").alias("token"), *known), f"{folder}/entries")
    links, named = None, None
    for number in range(HUB_ROUNDS + 1):
        if named is None:
            now = entries.withColumn("root", F.col("c"))
        else:
            now = entries.join(named, F.col("c") == F.col("node"), "left").select("token", *known, F.coalesce("root", "c").alias("root"))
        # the hub of the first round is the set with the fewest shingles of its own, then any
        central = F.struct(F.col("own") if number == 0 else F.lit(0), F.xxhash64(F.col("c"), F.lit(number)))
        mixed = now.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct(*known, "root"), central).alias("hub"))
        mixed = mixed.where("low <> high").select("token", "hub.*")
        if number < HUB_ROUNDS:
            hubs = mixed.select("token", *(F.col(k).alias(f"{k}_hub") for k in (*known, "root")))
            rows = now.select("token", *(F.col(k).alias(f"{k}_") for k in (*known, "root")))
            pairs = rows.join(hubs, "token").where((F.col("root_") != F.col("root_hub")) & _may_link("_", "_hub", percent))
            pairs = pairs.select(F.least("c_", "c_hub").alias("a"), F.greatest("c_", "c_hub").alias("b"))
        else:
            now = written(now.join(mixed.select("token"), "token", "left_semi"), f"{folder}/mixed")
            a, b = (now.select(F.col("token").alias(f"token_{s}"), *(F.col(k).alias(f"{k}_{s}") for k in (*known, "root"))) for s in "ab")
            pairs = a.join(b, (F.col("token_a") == F.col("token_b")) & (F.col("c_a") < F.col("c_b")) & (F.col("root_a") != F.col("root_b"))
                           & _may_link("_a", "_b", percent)).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        pairs = written(pairs.distinct(), f"{folder}/pairs-{number}")
        new = written(verified(pairs, heads, sets, percent), f"{folder}/links-{number}")
        if named is None or not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            named = components(links, f"{folder}/classes-{number}")
    return named


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                 percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id, the least id that links lead to, of every row."""
    folder = shared_dir(docs.sparkSession, "gramjoin")
    rows = written(set_rows(docs, id_col, text_col, size), f"{folder}/rows")
    classes = set_classes(rows, percent, folder)
    sets = open_sets(docs, classes, id_col, text_col, size, folder)
    heads = prefixes(sets, percent, folder)
    named = linked_classes(sets, heads, percent, folder)
    rooted = classes.join(named, F.col("c") == F.col("node"), "left").select("digest", "id", F.coalesce("root", "c").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    names = written(rooted.join(least, "root").select("digest", "component_id"), f"{folder}/names")
    found = rows.select("id", "n", "digest").join(names, "digest")
    return found.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
