"""Near-duplicate detection by circulant MinHash.

Two permutations of 2^20 places make every signature coordinate: the first places a shingle, the second, circularly shifted by the coordinate's number,
ranks the places; a coordinate is the least rank. The ranks of all shifts of a place lie next to each other in memory, so a signature is a
minimum over contiguous slices. Bands of coordinates bring similar sets together; only documents with a common band get the more numerous and longer bands
that groups are made of, so that texts with no more than a passage in common seldom meet. Pairs are confirmed by exact Jaccard similarity of full shingle sets.

Groups of any size are handled without forming all their pairs. Equal sets are one class. In a group every member is compared with one pivot, the
most central; members that are linked are one component, and groups within one component are settled. In the others only pairs across components matter. Where few members lie outside the
largest component, these are compared with the rest. Otherwise sets are split into what they share with the pivot and what they don't (own shingles): two
members have at most the lesser of their overlaps with the pivot in common besides own shingles, so a link needs a number of common own ones, and
one of these is among the rarest own shingles of both. Members with such a shingle in common form new groups, small ones compared by pairs. Large ones are split in turn by
what their members differ in from the set of shingles that most of them have; no such difference is in more than half of them, so the rounds grow as the logarithm of the largest group.
Every step is linear in the members, joins with texts are sorted merges at every size, and every round's tables are written to the shared folder and dropped when used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlattice.llm.common import LOWER, _ODD, distinct_sorted, dropped, ensure_workers_import, fresh, mix64, shingle_hashes, stored, words_of
from runlattice.llm.components import components

PLACES_BITS = 20
#: A pair at a similarity of 0.8 shares no band with a probability of (1 - 0.8^4)^40, below 1e-9.
ROWS, BANDS = 4, 40
NUMERATOR, DENOMINATOR = 4, 5
#: Bands by which only documents with a common band are grouped: 0.8 misses with (1 - 0.8^8)^120, below 3e-10; 0.4 meets in 8 of 100 pairs, with the bands above in 64.
FINE_ROWS, FINE_BANDS = 8, 120
#: Members outside the largest component of a group that are compared with all others; at most so many pairs a member come of it.
FEW = 8
#: The same for groups with a rare shingle in common; where more lie outside, the group gets a pivot of its own.
SMALL = 64
#: Edges of one document that a task of a comparison gets; more are dealt over several tasks.
EDGES = 64
#: Longs of parities that a document has. Of sets that differ in 20 shingles 5 in 6 differ in as many bits.
PARITIES = 16
#: Classes of set sizes: two sets of a similarity of 0.8 lie in the same class or in neighbouring ones.
CLASS = 1.25
SEED = 20


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles, sorted; with fewer words, of the whole sequence; none without words."""
    return distinct_sorted(shingle_hashes(words_of(text.translate(LOWER)), k))


class Circulant:
    """The two permutations and the signatures that they give."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = SEED) -> None:
        self.rows, self.bands = rows, bands
        random = np.random.default_rng(seed)
        n, k = 1 << PLACES_BITS, rows * bands
        self.first = random.permutation(n).astype(np.uint32)
        ranks = random.permutation(n).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:k]]), k)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = self.first[(mix64(hashes ^ _ODD[2]) >> np.uint64(64 - PLACES_BITS)).astype(np.int64)]
        out = self.shifted[places[:1024]].min(axis=0)
        for i in range(1024, len(places), 1024):
            out = np.minimum(out, self.shifted[places[i : i + 1024]].min(axis=0))
        return out

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        sig = self.signature(hashes).reshape(self.bands, self.rows).astype(np.uint64)
        key = mix64(np.arange(self.bands, dtype=np.uint64) + np.uint64(1))
        for r in range(self.rows):
            key = mix64(key ^ sig[:, r] * _ODD[r])
        return key.view(np.int64)


_CIRCULANT: list[Circulant] = []
_FINE: list[Circulant] = []


def signed(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """doc, n (set size), class_key (128 bits of the set), bands, z (compressed text) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _CIRCULANT:
            _CIRCULANT.append(Circulant())
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            n, key, bands, z = [], [], [], []
            for t in batch.column(1):
                raw = (t.as_py() or "").encode()
                s = shingle_set(raw, k)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(_CIRCULANT[0].band_keys(s) if len(s) else [])
                z.append(pack(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(z, pa.binary())], ["doc", "n", "class_key", "bands", "z"])

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(each, "doc bigint, n bigint, class_key binary, bands array<bigint>, z binary")


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 PARITIES bits, whether an odd number of the shingles fall on it. Two sets differ in at least as many shingles as their parities do in bits."""
    at = (mix64(hashes ^ _ODD[3]) >> np.uint64(32)) % np.uint64(64 * PARITIES)
    odd = np.bincount(at.astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def finely_grouped(texts: DataFrame, k: int) -> DataFrame:
    """Of the documents (doc, z) a stored table of doc, n, parities and longer bands, in which only few that are less alike than a link demands meet."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _FINE:
            _FINE.append(Circulant(FINE_ROWS, FINE_BANDS, SEED + 1))
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n, bands, odd = [], [], []
            for z in batch.column(1):
                s = shingle_set(unpack(z.as_py()), k)
                n.append(len(s))
                bands.append(_FINE[0].band_keys(s))
                odd.append(parities(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], ["doc", "n", "bands", "odd"])

    return stored(texts.select("doc", "z").mapInArrow(each, "doc bigint, n bigint, bands array<bigint>, odd array<bigint>"), "fine")


def near(one: str, two: str, sizes: Column) -> Column:
    """Whether the parities of two sets allow a link: their differing bits are no more than the shingles that a link lets differ."""
    bits = reduce(Column.__add__, (F.bit_count(F.col(one)[i].bitwiseXOR(F.col(two)[i])) for i in range(PARITIES)))
    return bits * (NUMERATOR + DENOMINATOR) <= sizes * (DENOMINATOR - NUMERATOR)


def shared(groups: DataFrame) -> DataFrame:
    """The stored rows (g, doc, n) of groups with several members, with their number m."""
    groups = stored(groups, "banded")
    out = stored(groups.join(groups.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").hint("merge"), "g"), "groups")
    dropped(groups)
    return out


def _sets(column: pa.Array, ids: list[int], k: int, held: dict[int, np.ndarray]) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    for i, z in zip(ids, column):
        s = held.get(i)
        if s is None:
            if len(held) > 2000:
                held.clear()
            s = held[i] = shingle_set(unpack(z.as_py()), k)
        yield s


def overlaps(k: int) -> object:
    """UDF of (a, za, b, zb): sizes and overlap of the two sets."""

    @F.arrow_udf("struct<na:bigint,nb:bigint,common:bigint>")
    def udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held: dict[int, np.ndarray] = {}
        for a, za, b, zb in batches:
            na, nb, common = [], [], []
            for x, y in zip(_sets(za, a.to_pylist(), k, held), _sets(zb, b.to_pylist(), k, held)):
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                na.append(len(x))
                nb.append(len(y))
                common.append(int((x[at] == y).sum()))
            yield pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (na, nb, common)], ["na", "nb", "common"])

    return udf


def own_shingles(k: int) -> object:
    """UDF of (a, za, b, zb): the shingles of a that b lacks."""

    @F.arrow_udf("array<bigint>")
    def udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held: dict[int, np.ndarray] = {}
        for a, za, b, zb in batches:
            out = []
            for x, y in zip(_sets(za, a.to_pylist(), k, held), _sets(zb, b.to_pylist(), k, held)):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                out.append(x[y[at] != x].view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    return udf


def differences(k: int) -> object:
    """UDF of (a, za, b, zb): the shingles that only one of a and b has."""

    @F.arrow_udf("array<bigint>")
    def udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held: dict[int, np.ndarray] = {}
        for a, za, b, zb in batches:
            out = []
            for x, y in zip(_sets(za, a.to_pylist(), k, held), _sets(zb, b.to_pylist(), k, held)):
                out.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    return udf


def similar(common: Column, na: Column, nb: Column) -> Column:
    """Whether common of na and nb shingles is a similarity of 4 in 5 or more."""
    return common * (NUMERATOR + DENOMINATOR) >= (na + nb) * NUMERATOR


def with_texts(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """edges (a, b, ...) with the texts za and zb. A document b with many edges is dealt over several tasks, EDGES to each."""
    hot = edges.groupBy("b").agg(F.ceil(F.count("*") / EDGES).cast("int").alias("parts")).filter("parts > 1")
    dealt = edges.join(hot, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    one = texts.select(F.col("doc").alias("a"), F.col("z").alias("za"))
    two = texts.select(F.col("doc").alias("b"), F.col("z").alias("zb")).join(edges.select("b").distinct(), "b", "left_semi").join(hot, "b", "left")
    two = two.select("b", "zb", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(one.hint("merge"), "a").join(two.hint("merge"), ["b", "part"]).drop("part")


def verified(edges: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b, na, nb, common of each edge (a, b)."""
    return with_texts(edges, texts).select("a", "b", overlaps(k)("a", "za", "b", "zb").alias("o")).select("a", "b", "o.*")


def with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """members with the root of the component that each doc belongs to so far."""
    if roots is None:
        return members.withColumn("root", F.col("doc"))
    return members.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(members: DataFrame, key: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The rows (key, root, ...) of groups that are in several components, with minor (not in the largest one), in two tables: groups with at most so many minor members, and the others."""
    by_root = members.groupBy(*key, "root").agg(F.count("*").alias("c"))
    per = by_root.groupBy(*key).agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("major")).filter("major.c < m").select(*key, F.col("major.root").alias("major"), (F.col("m") - F.col("major.c")).alias("rest"))
    rows = stored(members.join(per, key).withColumn("minor", F.col("root") != F.col("major")).drop("major"), "apart")
    few, many = rows.filter(F.col("rest") <= most), rows.filter(F.col("rest") > most)
    few._stored_at = rows._stored_at
    return few, many


def pairs_with_few(members: DataFrame) -> DataFrame:
    """Pairs across components within groups (g, doc, n, odd, root, minor), of which one is minor, whose sizes and parities allow a link."""
    left = members.filter("minor").select("g", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("odd").alias("odda"))
    right = members.select("g", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("odd").alias("oddb"))
    fits = (F.col("ra") != F.col("rb")) & similar(F.least("na", "nb"), F.col("na"), F.col("nb")) & near("odda", "oddb", F.col("na") + F.col("nb"))
    return ordered_pairs(left.join(right, "g").filter(fits))


def rarest(family: DataFrame, texts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of each edge (a, b, root, na, common) to a pivot b the own shingles of a, rarest in the family first, that a link can't do without: b, s, a, root, na, common.

    Shingles that one member has alone come first and meet nothing, so only shared ones are ranked. A partner has 4 in 5 of na shingles at least, which gives the number
    of common own ones that a link needs; one of as many fewer first ones is common. Second, the stored table of all own shingles, to be dropped after use.
    """
    own = with_texts(family.select("a", "b", "root", "na", "common"), texts).select("a", "b", "root", "na", "common", own_shingles(k)("a", "za", "b", "zb").alias("own"))
    own = stored(own.repartition("a", "b"), "own")
    token = own.select("b", F.explode("own").alias("s"), "a", "root", "na", "common")
    shared = token.withColumn("times", F.count("*").over(Window.partitionBy("b", "s"))).filter("times > 1")
    member = Window.partitionBy("b", "a")
    partner = F.ceil(F.col("na") * NUMERATOR / DENOMINATOR)
    need = F.greatest(F.lit(1), F.ceil((F.col("na") + partner) * NUMERATOR / (NUMERATOR + DENOMINATOR)) - F.col("common"))
    ranked = shared.withColumn("rank", F.row_number().over(member.orderBy("times", "s"))).withColumn("shared", F.count("*").over(member))
    return ranked.filter(F.col("rank") <= F.col("shared") - need + 1).select("b", "s", "a", "root", "na", "common"), own


def pairs_with_room(family: DataFrame) -> DataFrame:
    """Pairs across components of a family (a, b, root, na, nb, common) that could be linked without a common own shingle: both overlaps with the pivot b are enough.

    One of them isn't linked to the pivot, so the other is smaller than the pivot. They meet by classes of sizes.
    """
    room = (F.col("common") * (NUMERATOR + DENOMINATOR) - F.col("na") * NUMERATOR) / NUMERATOR
    size = F.floor(F.log("na") / math.log(CLASS)).cast("int")
    left = family.filter(~similar(F.col("common"), F.col("na"), F.col("nb"))).filter(room >= F.ceil(F.col("na") * NUMERATOR / DENOMINATOR))
    left = left.select("b", F.explode(F.sequence(size - 1, size + 1)).alias("size"), F.col("a").alias("x"), F.col("root").alias("rx"), F.col("na").alias("nx"), F.col("common").alias("cx"))
    right = family.filter(F.col("na") < F.col("nb")).select("b", size.alias("size"), F.col("a").alias("y"), F.col("root").alias("ry"), F.col("na").alias("ny"), F.col("common").alias("cy"))
    could = (F.col("rx") != F.col("ry")) & similar(F.least("cx", "cy"), F.col("nx"), F.col("ny"))
    return ordered_pairs(left.join(right, ["b", "size"]).filter(could).select(F.col("x").alias("a"), F.col("y").alias("b")))


def pairs_with_rare(members: DataFrame) -> DataFrame:
    """Pairs across components within groups (b, s), of which one is minor, whose parities, and overlaps with the pivot and own shingles together, allow a link."""
    side = lambda x: members.select("b", "s", F.col("a").alias(x), "minor", *(F.col(c).alias(c + x) for c in ("root", "na", "common", "odd")))
    x, y = side("x").filter("minor").drop("minor"), side("y").withColumnRenamed("minor", "both")
    most = F.least("commonx", "commony") + F.least(F.col("nax") - F.col("commonx"), F.col("nay") - F.col("commony"))
    once = ~F.col("both") | (F.col("x") < F.col("y"))
    fits = once & (F.col("rootx") != F.col("rooty")) & similar(most, F.col("nax"), F.col("nay")) & near("oddx", "oddy", F.col("nax") + F.col("nay"))
    return ordered_pairs(x.join(y, ["b", "s"]).filter(fits).select(F.col("x").alias("a"), F.col("y").alias("b")))


def by_majority(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Of each member (g, a, b, root, na) of a group with a pivot b a stored row: also d, in what it differs from the shingles that most of its group have, and over.

    Sets with the differences x and y differ in |x| + |y| - 2 |x and y| shingles, and a link allows a ninth of their sizes. over is 9 |d| - na: two members need
    a common difference for each 18 of the sum of theirs, and are linked in any case if it isn't above 0.
    """
    each = with_texts(members.select("a", "b").distinct(), texts).select("a", "b", differences(k)("a", "za", "b", "zb").alias("d"))
    rows = stored(members.join(each.hint("merge"), ["a", "b"]).select("g", "a", "root", "na", "d"), "own")
    times = rows.select("g", F.explode("d").alias("s")).groupBy("g", "s").agg(F.count("*").alias("times"))
    usual = times.join(rows.groupBy("g").agg(F.count("*").alias("m")), "g").filter("2 * times > m").groupBy("g").agg(F.collect_list("s").alias("usual"))
    d = F.when(F.col("usual").isNull(), F.col("d")).otherwise(F.concat(F.array_except("d", "usual"), F.array_except("usual", "d")))
    over = F.size("d") * (NUMERATOR + DENOMINATOR) - F.col("na") * (DENOMINATOR - NUMERATOR)
    out = stored(rows.join(usual, "g", "left").withColumn("d", d).select("g", "a", "root", "na", "d", over.alias("over")), "own")
    dropped(rows)
    return out


def nearest_pairs(members: DataFrame) -> DataFrame:
    """Pairs of the members (g, a, root, over) with the one of least over of their group, where that makes a link; others that need no common difference are linked by way of it."""
    least = members.groupBy("g").agg(F.min(F.struct("over", "a", "root")).alias("least"))
    near = members.join(least, "g").filter(F.col("over") + F.col("least.over") <= 0).filter(F.col("root") != F.col("least.root"))
    return ordered_pairs(near.select("a", F.col("least.a").alias("b")))


def rarest_differences(members: DataFrame) -> DataFrame:
    """Of the members (g, a, root, na, d, over) the differences s, rarest in the group first, that a link can't do without: g, s, a, root, na, over, own (their number in all)."""
    need = F.greatest(F.lit(1), F.ceil((F.col("over") + F.col("least")) / (2 * (NUMERATOR + DENOMINATOR))))
    of = members.join(members.groupBy("g").agg(F.min("over").alias("least")), "g").withColumn("need", need)
    token = of.select("g", F.explode("d").alias("s"), "a", "root", "na", "over", F.size("d").alias("own"), "need")
    shared = token.withColumn("times", F.count("*").over(Window.partitionBy("g", "s"))).filter("times > 1")
    member = Window.partitionBy("g", "a")
    ranked = shared.withColumn("rank", F.row_number().over(member.orderBy("times", "s"))).withColumn("shared", F.count("*").over(member))
    return ranked.filter("rank <= shared - need + 1").select("g", "s", "a", "root", "na", "over", "own")


def pairs_with_difference(members: DataFrame) -> DataFrame:
    """Pairs across components within groups (g, s), of which one is minor, whose parities and numbers of differences allow a link."""
    side = lambda x: members.select("g", "s", F.col("a").alias(x), "minor", *(F.col(c).alias(c + x) for c in ("root", "na", "over", "own", "odd")))
    x, y = side("x").filter("minor").drop("minor"), side("y").withColumnRenamed("minor", "both")
    once = ~F.col("both") | (F.col("x") < F.col("y"))
    fits = once & (F.col("rootx") != F.col("rooty")) & similar(F.least("nax", "nay"), F.col("nax"), F.col("nay"))
    fits &= F.least("ownx", "owny") * 2 * (NUMERATOR + DENOMINATOR) >= F.col("overx") + F.col("overy")
    fits &= near("oddx", "oddy", F.col("nax") + F.col("nay"))
    return ordered_pairs(x.join(y, ["g", "s"]).filter(fits).select(F.col("x").alias("a"), F.col("y").alias("b")))


def linked(edges: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    return stored(verified(edges, texts, k).filter(similar(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b"), "links")


def joined_components(links: DataFrame, before: DataFrame | None) -> DataFrame:
    """The components (node, root) that the stored links and those found before make; both tables are dropped if they are no longer needed."""
    if before is None:
        after = components(links)
    elif links.isEmpty():
        after = before
    else:
        after = components(links.union(before.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        dropped(before)
    dropped(links)
    return after


def clustered(groups: DataFrame, all_texts: DataFrame, k: int) -> DataFrame | None:
    """(node, root) of the components that links of a similarity of 4 in 5 or more make of documents that share a group (g, doc, n); None without groups.

    The pivot of a group is its most central member: that in the most and largest groups. In a family of edited copies this is one with few
    edits, to which nearly all that can be linked is linked at once.
    """
    roots: DataFrame | None = None
    alike = stored(groups.join(groups.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").hint("merge"), "g").select("doc").distinct(), "alike")
    texts = stored(all_texts.join(alike.hint("merge"), "doc", "left_semi"), "texts")
    dropped(alike)
    fine = finely_grouped(texts, k)
    groups = shared(fine.select(F.explode("bands").alias("g"), "doc", "n"))
    odd = fine.select("doc", "odd").hint("merge")
    odd_of_a = fine.select(F.col("doc").alias("a"), "odd").hint("merge")
    while not groups.isEmpty():
        first = roots is None
        if not first:  # settled by now?
            labelled = with_roots(groups, roots)
            per = labelled.groupBy("g").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g", "m")
            members = stored(labelled.join(per, "g").select("g", "doc", "n", "m"), "members")
            dropped(groups)
        else:
            members = groups
        central = members.groupBy("doc").agg(F.sum("m").alias("weight"))
        pivots = members.join(central, "doc").groupBy("g").agg(F.max_by("doc", F.struct("weight", -F.col("doc"))).alias("pivot"))
        around = stored(members.join(pivots, "g").select("g", "doc", "n", "pivot"), "around")
        dropped(members)
        edges = stored(around.filter("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct(), "edges")
        star = stored(verified(edges, texts, k), "stars")
        dropped(edges)
        links = stored(star.filter(similar(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b"), "links")
        roots = joined_components(links, roots)

        few, many = apart(with_roots(around, roots), ["g"], FEW)
        dropped(around)
        pairs = pairs_with_few(few.join(odd, "doc"))
        over = [star, few]
        rest = many.filter("doc <> pivot").select("g", F.col("doc").alias("a"), F.col("pivot").alias("b"), "root", F.col("n").alias("na"))
        if first:
            family = stored(rest.select("a", "b", "root").distinct().join(star, ["a", "b"]), "family")
        else:
            family = by_majority(rest, texts, k)
        over.append(family)
        if family.isEmpty():
            groups = family
        elif first:
            rare, own = rarest(family, texts, k)
            few, many = apart(rare, ["b", "s"], SMALL)
            dropped(own)
            over.append(few)
            pairs = pairs.union(pairs_with_room(family)).union(pairs_with_rare(few.join(odd_of_a, "a")))
            groups = stored(many.select(F.xxhash64("b", "s").alias("g"), F.col("a").alias("doc"), F.col("na").alias("n")), "groups")
        else:
            few, many = apart(rarest_differences(family), ["g", "s"], SMALL)
            over.append(few)
            pairs = pairs.union(nearest_pairs(family)).union(pairs_with_difference(few.join(odd_of_a, "a")))
            groups = stored(many.select(F.xxhash64("g", "s").alias("g"), F.col("a").alias("doc"), F.col("na").alias("n")), "groups")
        edges = stored(pairs.distinct(), "pairs")
        links = linked(edges, texts, k)
        for t in [*over, edges]:
            if t is not groups:
                dropped(t)
        roots = joined_components(links, roots)
    dropped(texts)
    dropped(fine)
    dropped(groups)
    return roots


def near_duplicates(docs: DataFrame, k: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least id that links reach), kept (doc_id is component_id).

    Words are runs of other than ASCII white space, A-Z lower-cased. Documents without words have an empty set and link with nothing. Rows that share an id are
    one document; of different texts that with the least digest is compared. A null id links with nothing, has no component and is kept. Empty tables give no rows.
    """
    ensure_workers_import(docs.sparkSession)
    rows = stored(signed(docs, k, doc_id, text), "signed")
    sizes = stored(rows.select("doc", "n", "class_key"), "sizes")
    usable = "n > 0 AND doc IS NOT NULL"
    held, single = [rows], sizes.filter(usable).select("doc", "class_key")
    full = rows.filter(usable)
    if not single.groupBy("doc").count().filter("count > 1").isEmpty():
        full = stored(full.groupBy("doc").agg(F.min(F.struct("class_key", "n", "bands", "z")).alias("r")).select("doc", "r.*"), "single")
        held.append(full)
        single = stored(full.select("doc", "class_key"), "classed")
    classes = stored(single.groupBy("class_key").agg(F.min("doc").alias("lead")), "classes")
    ones = full.select("doc", "n", "bands", "z").join(classes.select(F.col("lead").alias("doc")).hint("merge"), "doc", "left_semi")
    roots = clustered(ones.select(F.explode("bands").alias("g"), "doc", "n"), full.select("doc", "z"), k)
    for t in held:
        dropped(t)
    # The lead of a class is its least document, so the least lead that links reach is the least document.
    lead = classes.select("class_key", F.col("lead").alias("doc"))
    lead = stored((with_roots(lead, roots)).select("class_key", "root"), "roots")
    of_doc = single.join(lead, "class_key").select(F.col("doc").alias("node"), "root")
    out = sizes.select("doc", "n").join(of_doc, F.col("doc") == F.col("node"), "left")
    component = F.coalesce("root", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the least id; columns stay as they are, whatever their names.

    Null ids and texts without words stay; an empty table stays empty.
    """
    name = fresh(docs, "gone")
    gone = near_duplicates(docs, k, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`").cast("bigint") == F.col(name), "left_anti")
