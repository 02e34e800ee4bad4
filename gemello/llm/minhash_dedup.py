"""Near-duplicate documents by b-bit MinHash, with links confirmed on full shingle sets.

Each text becomes the set of its word shingles. Documents with equal sets form a class, represented by its smallest
doc_id. Each class has BANDS * ROWS minima of random permutations; each band's minima hash to a bucket, and of every
minimum the low BITS bits are kept in a packed signature. Classes that share a bucket are candidates:

1. Each bucket's smallest representative (its hub) is paired with the other members. Pairs whose similarity, estimated
   from bit counts of the signatures and corrected for chance collisions, is out of reach are set aside; the others are
   confirmed on the full sets. Confirmed links give components.
2. What is left of a bucket, without its hub, still matters only where members lie in different components. Those
   outside the bucket's largest component are compared with that component's members, once however many buckets they
   share, and with each other. Both go tile by tile, with blocks of bounded size on either side: first on signatures,
   which leave the classes that have another one within reach in the tile, then those on their full sets; only links
   leave a tile. The links of both steps give the final components.

A fingerprint, bucket or hub may hold a large share of all rows: joins on them are salted (`spread`). Star steps join rows
of two ids, which adaptive execution splits where one root has too many of them.

So every candidate pair is either confirmed, out of reach, or within one component already; no bucket is capped and no
group is collected. A pair of similarity 0.8 shares no bucket with a probability below 5e-6, and is estimated below
reach with one below 1e-7. Intermediate tables are written to the shared folder of spark.checkpoint.dir.

Defined results: texts without words have an empty set and are linked with nothing; with fewer words than a shingle has,
the whole sequence is one; rows that share a doc_id are one document; rows without a doc_id aren't linked, they come
back with a null component and kept; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemello.llm.text import appended, delete, flat, hashes, lower, mix, release, shared_dir, through, words, written

BANDS, ROWS, BITS = 40, 6, 4
#: Estimates this far below the threshold, in standard deviations of the estimator, are out of reach.
SIGMAS = 5.5
#: A side of a tile holds about so many sets at most, and so many shingles.
TILE, TILE_SHINGLES = 256, 1 << 16
#: A key with more than this part of a join's rows is dealt to several tasks.
MANY = 1000
SEED = 20240229


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


_A, _B = _permutations()


def shingles(col: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of `size` words, A-Z in lower case."""
    data, offsets = flat(col)
    data = lower(data)
    starts, ends, at = words(data, offsets)
    h = hashes(data, starts, ends)
    n = max(0, len(h) - size + 1)
    rolled = h[:n].copy()
    for k in range(1, size):
        rolled = mix(rolled) + h[k : k + n]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            x = h[a : a + 1].copy()
            for k in range(a + 1, b):
                x = mix(x) + h[k]
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each nonempty set, the minima of all permutations over its shingles."""
    out = np.zeros((len(sets), len(_A)), np.uint32)
    room = np.empty((len(_A), 1024), np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            own = x[at : at + 1024]
            v = room[:, : len(own)]
            np.multiply(_A[:, None], own[None, :], out=v)
            np.add(v, _B[:, None], out=v)
            np.minimum(best, v.min(axis=1), out=best)
        out[i] = best
    return out


def buckets(low: np.ndarray) -> np.ndarray:
    """The bucket of each band, as 64-bit hashes."""
    rows = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + rows[:, :, r])
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS (4) bits of all minima, two in a byte."""
    bits = (low & np.uint32(15)).astype(np.uint8)
    return bits[:, ::2] | bits[:, 1::2] << 4


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures: the share of equal minima by bit counts, less chance collisions of BITS bits."""
    x = a ^ b
    x = x | x >> 1
    x = (x | x >> 2) & 0x11
    equal = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / (BANDS * ROWS)
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def reach(percent: int) -> float:
    """The lowest estimate from which a pair of at least this similarity must be confirmed."""
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * percent / 100
    return percent / 100 - SIGMAS * (equal * (1 - equal) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


FIELDS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("fingerprint", T.BinaryType()),
    T.StructField("signature", T.BinaryType()),
    T.StructField("buckets", T.ArrayType(T.LongType())),
]


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, and of nonempty sets fingerprint (128 bits of the set), signature and buckets."""
    _128 = (np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D))

    def work(cols: list[pa.Array]) -> list:
        sets = shingles(cols[0], size)
        filled = [s for s in sets if len(s)]
        low = minima(filled)
        marks = [b"".join(int(mix(s * m + m).sum(dtype=np.uint64)).to_bytes(8, "big") for m in _128) for s in filled]
        place = np.cumsum([len(s) > 0 for s in sets]) - 1
        pick = pa.array(place, mask=np.array([len(s) == 0 for s in sets], bool))
        sig, keys = packed(low), buckets(low)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(filled) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
        return [[len(s) for s in sets], pa.array(marks, pa.binary()).take(pick), pa.array([s.tobytes() for s in sig], pa.binary()).take(pick), lists.take(pick)]

    return appended(documents, ["text"], FIELDS, work, ["doc_id"])


def spread(left: DataFrame, right: DataFrame, on: str, counts: DataFrame) -> DataFrame:
    """left joined with right's one row for each key `on`; counts, a written table, says how many rows n of left have each key.

    Keys with more than a MANYth part of all rows (so MANY at most, whose list is broadcast) are dealt to several tasks;
    where none has, the join is a plain one. Plans name the lineages of left and right once: each copy of them takes the
    driver's memory.
    """
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if not total or most < 2 or most * MANY <= total:
        return left.join(right, on)
    heavy = counts.where(f"n * {MANY} > {total} and n > 1").select(F.col(on).alias("__k"), F.ceil(F.col("n") * MANY / total).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(F.broadcast(heavy), F.col(on) == F.col("__k"), "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("__k", "__parts")
    copies = right.join(F.broadcast(heavy), F.col(on) == F.col("__k"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__k", "__parts")
    return dealt.join(copies, [on, "__salt"]).drop("__salt")


def _in_reach(pairs: DataFrame, signatures: DataFrame, percent: int, where: str) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule the link out."""
    least = reach(percent)
    sa = signatures.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"))
    sb = signatures.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"))
    n = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), where)
    both = spread(pairs.join(sb, "b"), sa, "a", n).select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            a, b = (flat(batch.column(i))[0].reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.filter(pa.array(estimated(a, b) >= least)).select([0, 1]) if batch.num_rows else batch.select([0, 1])

    return through(both, run, "a long, b long")


def _bitset(ids: DataFrame, n: int) -> np.ndarray:
    """A set of hashed ids as bits, of a size that follows n and stays within 8 MB; on more ids it only lets more rows pass."""
    size = 1 << min(26, max(16, (32 * n).bit_length()))

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = np.unique(mix(batch.column(0).to_numpy().astype(np.uint64)) & np.uint64(size - 1))
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in through(ids.coalesce(12), run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def _wanted(documents: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id and text of the documents with these ids, and of few others: what is not wanted goes before any shuffle."""
    bits = documents.sparkSession.sparkContext.broadcast(_bitset(ids, n))

    def wanted(batches):
        have = bits.value
        for batch in batches:
            h = mix(batch.column(0).to_numpy().astype(np.uint64)) & np.uint64(8 * len(have) - 1)
            yield batch.filter(pa.array((have[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1))

    return through(documents.where("doc_id is not null and text is not null").select("doc_id", "text"), wanted, documents.select("doc_id", "text").schema)


def _confirmed(documents: DataFrame, pairs: DataFrame, size: int, percent: int, where: str) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets of their documents."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = _wanted(documents, ids, 2 * pairs.count())

    def compare(cols: list[pa.Array]) -> list:
        sa, sb = shingles(cols[0], size), shingles(cols[1], size)
        ok = np.zeros(len(sa), bool)
        for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= percent * (len(both) - shared)
        return [ok]

    ta, tb = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    n = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), where)
    both = spread(pairs.join(tb, "b"), ta, "a", n)
    return appended(both, ["ta", "tb"], [T.StructField("linked", T.BooleanType())], compare, ["a", "b"]).where("linked").select("a", "b").distinct()


def components(links: DataFrame, where: str) -> DataFrame:
    """node and root, the smallest node of its component, for all nodes of links (a, b): large and small stars in turn."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{where}/0")
    sign = None
    for step in range(1, 100):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        # rows are pairs of ids: a root's share of them is far below a task's memory, and adaptive execution splits what isn't
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        edges = written(small, f"{where}/{step}")
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if step > 1:
            delete(edges.sparkSession, f"{where}/{step - 1}")
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("components didn't converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _cuts(n, shingles_):
    """Into how many blocks a side of a tile is cut."""
    return F.greatest(F.ceil(n / TILE), F.ceil(shingles_ / TILE_SHINGLES)).cast("int")


def _block(cuts: str):
    return F.expr(f"cast(pmod(xxhash64(rep), {cuts}) as int)")


def _tiles(placed: DataFrame, roots: DataFrame, counts: DataFrame, where: str) -> DataFrame:
    """Rows (tile, side, rep) of all comparisons that members (key, rep, comp) of buckets still need; counts has rep and n.

    Members outside their bucket's largest component are written to `where`: most parts of the plan begin with them.
    """
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"), F.col("top.comp").alias("main"))
    others = placed.join(main, F.col("key") == F.col("k")).where("comp != main").select("key", "rep", "main")
    others = written(others.join(counts, "rep"), where)
    # against the members of the largest component
    left = others.select("main", "rep", "n").distinct()
    mains = left.groupBy("main").agg(F.count(F.lit(1)).alias("q"), F.sum("n").alias("qn"))
    own = roots.select(F.col("node").alias("rep"), F.col("root").alias("main")).union(mains.select(F.col("main").alias("rep"), "main")).distinct()
    right = own.join(mains, "main").join(counts, "rep")
    sides = right.groupBy("main").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("rn"), F.first("q").alias("q"), F.first("qn").alias("qn"))
    sides = sides.select(F.col("main").alias("of"), _cuts(F.col("q"), F.col("qn")).alias("cut0"), _cuts(F.col("r"), F.col("rn")).alias("cut1"))
    tile = F.struct(F.lit(0).alias("kind"), F.col("main").alias("of"), F.col("i"), F.col("j")).alias("tile")
    one = left.join(sides, F.col("main") == F.col("of")).withColumn("i", _block("cut0")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cut1") - 1))).select(tile, F.lit(0).alias("side"), "rep")
    two = right.join(sides, F.col("main") == F.col("of")).withColumn("j", _block("cut1")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cut0") - 1))).select(tile, F.lit(1).alias("side"), "rep")
    # with each other
    rest = others.groupBy("key").agg(F.count(F.lit(1)).alias("q"), F.sum("n").alias("qn")).where("q > 1").select(F.col("key").alias("of"), _cuts(F.col("q"), F.col("qn")).alias("cut"))
    rows = others.join(rest, F.col("key") == F.col("of")).withColumn("mine", _block("cut")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    tile = F.struct(F.lit(1).alias("kind"), F.col("key").alias("of"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).alias("tile")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return one.unionByName(two).unionByName(rows.select(tile, side.alias("side"), "rep")).distinct()


def _near_tiles(tiles: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The rows (tile, side, rep) of tiles whose signature is within reach of another one's that they are compared with."""
    least = reach(percent)
    own = signatures.select(F.col("doc_id").alias("rep"), "signature")
    full = tiles.join(own, "rep").groupBy("tile").agg(F.collect_list(F.struct("side", "rep", "signature")).alias("rows"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(1)[i].values
                side, rep = (rows.field(k).to_numpy() for k in (0, 1))
                if len(rep) < 2:
                    continue
                sig = flat(rows.field(2))[0].reshape(len(rep), -1)
                near = np.zeros(len(rep), bool)
                left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
                for k in left.tolist():
                    hit = right[(estimated(sig[k], sig[right]) >= least) & (rep[right] != rep[k])]
                    near[hit] = True
                    near[k] |= len(hit) > 0
                found = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(found), i))), pa.array(side[found]), pa.array(rep[found])], names=["tile", "side", "rep"])
        release()

    return through(full, run, tiles.select("tile", "side", "rep").schema)


def _links_of_tiles(documents: DataFrame, tiles: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (a, b) in tiles: rows of side 0 against side 1, rows of side 2 against each other, all on full sets."""
    ids = tiles.select(F.col("rep").alias("id")).distinct()
    texts = _wanted(documents, ids, tiles.count())
    sets = appended(texts, ["text"], [T.StructField("shingles", T.BinaryType())], lambda cols: [[x.tobytes() for x in shingles(cols[0], size)]], ["doc_id"])
    full = tiles.join(sets, F.col("rep") == F.col("doc_id")).groupBy("tile").agg(F.collect_list(F.struct("side", "rep", "shingles")).alias("rows"))

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        held = [(r["side"], r["rep"], np.frombuffer(r["shingles"], np.uint64)) for r in rows]
        left = [x for x in held if x[0] != 1]
        right = [x for x in held if x[0] != 0]
        if not left or not right:
            return []
        joined = np.concatenate([x[2] for x in right])
        n = np.array([len(x[2]) for x in right])
        starts = np.cumsum(n) - n
        reps = np.array([x[1] for x in right])
        out = []
        for _, rep, own in left:
            at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            shared = np.add.reduceat((own[at] == joined).astype(np.int64), starts)
            near = np.flatnonzero((100 * shared >= percent * (n + len(own) - shared)) & (reps != rep))
            out += [(min(rep, x), max(rep, x)) for x in reps[near].tolist()]
        return out

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                if found := set(links(batch.column(0)[i].as_py())):
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release()

    return through(full.select("rows"), run, "a long, b long").distinct()


def deduplicated(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) and kept (the document is its component's first)."""
    spark = documents.sparkSession
    where = shared_dir(spark)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(sketches(documents, size), f"{where}/sketches")
    filled = sketch.where("doc_id is not null and n_shingles > 0")
    classes = written(filled.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), f"{where}/classes")
    first = filled.join(classes.select(F.col("rep").alias("r"), F.col("fingerprint").alias("f")), (F.col("doc_id") == F.col("r")) & (F.col("fingerprint") == F.col("f")))
    placed = first.select(F.explode("buckets").alias("key"), F.col("doc_id").alias("rep"))
    shared = written(placed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).where("hub < last").select("key", "hub", "n"), f"{where}/shared")
    members = written(spread(placed, shared.drop("n"), "key", shared.select("key", "n")).where("rep != hub").select("key", "hub", "rep"), f"{where}/members")
    pairs = written(_in_reach(members.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), filled, percent, f"{where}/hubs"), f"{where}/pairs1")
    links = written(_confirmed(documents, pairs, size, percent, f"{where}/confirmed"), f"{where}/links1")
    roots = components(links, f"{where}/components1")
    placed = members.join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("comp")).distinct()
    counts = filled.groupBy(F.col("doc_id").alias("rep")).agg(F.max("n_shingles").alias("n"))
    tiles = written(_near_tiles(_tiles(placed, roots, counts, f"{where}/others"), filled, percent), f"{where}/tiles")
    found = written(_links_of_tiles(documents, tiles, size, percent), f"{where}/links2")
    if found.limit(1).count():
        # stars of the first step's components stand for its links
        roots = components(roots.select("node", "root").toDF("a", "b").union(found), f"{where}/components2")
    for done in ("shared", "members", "hubs", "pairs1", "confirmed", "links1", "others", "tiles", "links2"):
        delete(spark, f"{where}/{done}")
    of_class = classes.join(roots, F.col("rep") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "rep").alias("label"))
    # rows that share a doc_id are one document, whatever their texts: the smallest label holds for all
    label = spread(filled.select(F.col("doc_id").alias("id"), "fingerprint"), of_class, "fingerprint", classes.select("fingerprint", "n")).groupBy("id").agg(F.min("label").alias("label"))
    out = sketch.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("label", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component, F.coalesce(F.col("doc_id") == F.coalesce("label", "doc_id"), F.lit(True)).alias("kept"))
