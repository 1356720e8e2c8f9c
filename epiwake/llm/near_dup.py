"""Near-duplicate documents: MinHash bands propose pairs, full shingle sets confirm them.

Each document gets ``rows * bands`` minima of universal hashes over its word shingles. Documents
that agree on all minima of a band share a bucket. Equal shingle sets are one representative from
the start. Texts with more shingles of their own than the similarity allows are like no other and
drop out. In a bucket not all pairs are compared: first every member meets the pivot with the least
of its own, which in a group of copies is nearest to their origin, and only buckets that still span
several components go on, with further pivots while a round settles half of the pairs. Then the
signatures of what is left are compared in blocks inside the tasks, members outside a bucket's
largest component against all; pairs that agree have their whole sets intersected there, as 32-bit
hashes that can only overstate the common part, and only what still is alike leaves a task to be
confirmed. So no link between two components that share a bucket is lost. With 40 bands of 6 rows a pair
of similarity 0.8 shares no bucket with probability 5e-6.

Defined results: a null or blank text has no shingles, is linked with nothing and is its own
component. A text with fewer words than a shingle is one shingle. Where ids repeat or are missing,
every row is a document of its own (``common.keyed``, missing ids last): each text under an id is
linked, a component has the smallest id of its rows, which is null only if all of them are, and of
rows with a null id the first of a component is kept. An empty table gives an empty result, and other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Steps, WordHashes, arrow_rows, bucket_count, bucket_of, keyed, mixed, pack_planes, shingle_hashes, split_by, unpack_planes
from .components import connected_components

ROWS, BANDS = 6, 40
#: Members of one pivot that share a copy of its text in the comparison.
PER_PIVOT = 1000
#: Members of a bucket outside its largest component, and all of its members, that share one task's
#: comparison of signatures, about.
OUTSIDE, ALL = 512, 8192


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Minima of ``factor * x + shift`` modulo 2^32 over the shingles, for each hash function."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(factors.size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, x.size, 1024):
        part = x[at:at + 1024]
        for k in range(0, factors.size, 40):
            values = part[None, :] * factors[k:k + 40, None]
            values += shifts[k:k + 40, None]
            np.minimum(least[k:k + 40], values.min(axis=1), out=least[k:k + 40])
    return least


def _hash_functions(count: int, seed: int = 20240501) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def sketches(docs: DataFrame, width: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, id, n_shingles, set_key, sig, bands): one byte of each minimum and a key per band.

    ``set_key`` is a 128-bit digest of the whole set, null without shingles; ``id`` passes through.
    """

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        import xxhash

        cache, (factors, shifts) = WordHashes(), _hash_functions(rows * bands)
        salt = np.arange(bands, dtype=np.uint64)[:, None] << np.uint64(40)
        for doc_id, own_id, text in stream:
            hashes = np.unique(shingle_hashes(cache.of(words_of(text)), width))
            if not hashes.size:
                yield doc_id, own_id, 0, None, None, None
                continue
            least = signature(hashes, factors, shifts)
            keys = np.zeros(bands, dtype=np.uint64)
            for column in (least.reshape(bands, rows).astype(np.uint64) + salt).T:
                keys = mixed(keys ^ column)
            yield (doc_id, own_id, hashes.size, xxhash.xxh3_128_digest(hashes.tobytes()),
                   (least & np.uint32(255)).astype(np.uint8).tobytes(), keys.view(np.int64).tolist())

    return arrow_rows(docs, ["doc_id", "id", "text"], run,
                      "doc_id long, id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union, with both sizes.

    A pivot's text meets its members in groups of at most about ``PER_PIVOT``; members stream past it.
    """
    degree = pairs.groupBy("u").agg(F.count("*").alias("n"))
    spread = pairs.join(degree, "u").withColumn(
        "g", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / PER_PIVOT))).select("u", "v", "g")
    members = spread.join(texts, spread["v"] == texts["doc_id"]).select("u", "g", F.col("v").alias("w"), F.lit(1).alias("side"), "ztext")
    pivots = spread.select("u", "g").distinct().join(texts, F.col("u") == texts["doc_id"]).select("u", "g", F.col("u").alias("w"), F.lit(0).alias("side"), "ztext")
    dealt = pivots.unionAll(members).repartition("u", "g").sortWithinPartitions("u", "g", "side", "w")

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        import zstandard

        cache, opened = WordHashes(), zstandard.ZstdDecompressor()
        pivot = None
        for u, w, side, packed in stream:
            hashes = np.unique(shingle_hashes(cache.of(opened.decompress(packed).translate(LOWER).split()), width))
            if side == 0:
                pivot = hashes
                continue
            both = np.intersect1d(pivot, hashes, assume_unique=True).size
            union = pivot.size + hashes.size - both
            if 100 * both >= percent * union:
                yield u, w, both, union

    return arrow_rows(dealt, ["u", "w", "side", "ztext"], run, "u long, v long, n_both long, n_union long")


def _packed_texts(docs: DataFrame) -> DataFrame:
    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for doc_id, text in stream:
            yield doc_id, packer.compress((text or "").encode("utf-8", "surrogatepass"))

    return arrow_rows(docs, ["doc_id", "text"], run, "doc_id long, ztext binary")


def _private_counts(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, private): how many shingles of each text no other of these texts has."""
    buckets = bucket_count(texts)

    def spread(stream: Iterator[tuple]) -> Iterable[tuple]:
        import zstandard

        cache, opened = WordHashes(), zstandard.ZstdDecompressor()
        held, size = [], 0

        def flush() -> Iterable[tuple]:
            ids = np.repeat(np.array([h[0] for h in held], dtype=np.int64), [h[1].size for h in held])
            hashes = np.concatenate([h[1] for h in held])
            # A shingle of several texts leaves the block as one row that names none of them.
            hashes, first, times = np.unique(hashes, return_index=True, return_counts=True)
            by_text = np.argsort(first)  # neighbours of one text pack well
            hashes, ids = hashes[by_text], np.where(times > 1, -1, ids[first])[by_text]
            for bucket, h, d in split_by((hashes % np.uint64(buckets)).astype(np.int64), hashes, ids):
                yield bucket, h.tobytes(), pack_planes(d)

        for doc_id, packed in stream:
            hashes = np.unique(shingle_hashes(cache.of(opened.decompress(packed).translate(LOWER).split()), width))
            held.append((doc_id, hashes))
            size += hashes.size
            if size >= 4_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def single(stream: Iterator[tuple]) -> Iterable[tuple]:
        blocks = [(np.frombuffer(h, np.uint64), unpack_planes(d)) for _, h, d in stream]
        if not blocks:
            return
        hashes, ids = (np.concatenate(x) for x in zip(*blocks))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        alone = np.ones(hashes.size, dtype=bool)
        alone[1:] &= hashes[1:] != hashes[:-1]
        alone[:-1] &= hashes[1:] != hashes[:-1]
        ids = ids[order][alone]
        docs, counts = np.unique(ids[ids != -1], return_counts=True)
        for bucket, d, c in split_by(bucket_of(docs, buckets), docs, counts):
            yield bucket, pack_planes(d), pack_planes(c)

    def total(stream: Iterator[tuple]) -> Iterable[tuple]:
        blocks = [(unpack_planes(d), unpack_planes(c)) for _, d, c in stream]
        if not blocks:
            return
        docs, counts = (np.concatenate(x) for x in zip(*blocks))
        found, at = np.unique(docs, return_inverse=True)
        yield from zip(found.tolist(), np.bincount(at, weights=counts).astype(np.int64).tolist())

    packed_schema = "bucket long, a binary, b binary"
    dealt = arrow_rows(texts, ["doc_id", "ztext"], spread, packed_schema).repartitionById(buckets, F.col("bucket").cast("int"))
    counted = arrow_rows(dealt, ["bucket", "a", "b"], single, packed_schema).repartitionById(buckets, F.col("bucket").cast("int"))
    return arrow_rows(counted, ["bucket", "a", "b"], total, "doc_id long, private long")


def _promising(pairs: DataFrame, few: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose sizes, private shingles or signatures rule the similarity out.

    A common part is at most what is not private in either text: an exact bound. Signature agreement
    is a mean of ``rows * bands`` trials; its cut lies five deviations below the threshold.
    """
    side = [few.select(F.col("doc_id").alias(k), F.col("sig").alias(f"s{k}"), F.col("n_shingles").alias(f"n{k}"), F.col("shared").alias(f"m{k}")) for k in "uv"]
    most = F.least("mu", "mv")
    wide = pairs.join(side[0], "u").join(side[1], "v").where(most * 100 >= (F.col("nu") + F.col("nv") - most) * percent)

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        p = percent / 100
        for u, v, su, sv in stream:
            a, b = np.frombuffer(su, np.uint8), np.frombuffer(sv, np.uint8)
            if (a == b).mean() >= p - 5 * (p * (1 - p) / a.size) ** 0.5:
                yield u, v

    return arrow_rows(wide, ["u", "v", "su", "sv"], run, "u long, v long")


def pack_short(hashes: np.ndarray) -> bytes:
    """24 bits of each hash, sorted, repeats included, as compressed differences."""
    import zstandard

    short = np.sort((hashes >> np.uint64(40)).astype(np.uint32))
    return zstandard.ZstdCompressor(level=1).compress(pack_planes(np.diff(short, prepend=np.uint32(0)).astype(np.int64)))


def unpack_short(packed: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(unpack_planes(zstandard.ZstdDecompressor().decompress(packed)))


def _short_sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, short): the sorted upper 24 bits of the shingle hashes of each text, repeats included."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        import zstandard

        cache, opened = WordHashes(), zstandard.ZstdDecompressor()
        for doc_id, packed in stream:
            yield doc_id, pack_short(np.unique(shingle_hashes(cache.of(opened.decompress(packed).translate(LOWER).split()), width)))

    return arrow_rows(texts, ["doc_id", "ztext"], run, "doc_id long, short binary")


def _at_most_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes of ``b`` are in the sorted ``a``: at least the common part of the two sets."""
    at = np.searchsorted(a, b)
    at[at == a.size] = 0
    return int(np.count_nonzero(a[at] == b))


def _left_over(here: DataFrame, open_bands: DataFrame, texts: DataFrame, width: int, percent: int, steps: Steps) -> DataFrame:
    """(u, v) of different components that share an open band and are alike by their short sets.

    The members outside a band's largest component are dealt to blocks of about ``OUTSIDE``; each
    block meets all members of the band, in parts of about ``ALL``. A band of one block and one part
    travels once, other rows once per block they meet; pairs that are not alike exist only as arrays of a
    task.
    """
    in_open = here.select("doc_id", F.explode("bands").alias("band")).join(open_bands.select("band"), "band", "left_semi")
    short = steps.save(_short_sets(texts.join(in_open.select("doc_id").distinct(), "doc_id", "left_semi"), width), "short")
    blocks, parts = F.ceil((F.col("m") - F.col("largest.n")) / OUTSIDE), F.ceil(F.col("m") / ALL)
    # Places first: rows of a few numbers. The sets follow them by document.
    placed = steps.save(here.select("doc_id", "component", F.explode("bands").alias("band")).join(
        open_bands.select("band", F.col("largest.component").alias("main"), blocks.alias("blocks"), parts.alias("parts")), "band"), "placed")
    about = ["band", "doc_id"]
    alone = (F.col("blocks") == 1) & (F.col("parts") == 1)
    outside = placed.where((F.col("component") != F.col("main")) & ~alone).select(
        *about, F.lit(0).alias("side"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # In a band that travels once, side 1 stands for a row that is both outside and one of all members.
    side = F.when(alone & (F.col("component") != F.col("main")), 1).otherwise(2)
    everyone = placed.select(
        *about, side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).alias("part"))
    sets = here.select("doc_id", "component", "n_shingles", "shared", "sig").join(short, "doc_id")
    dealt = outside.unionByName(everyone).join(sets, "doc_id").repartition("band", "block", "part").sortWithinPartitions("band", "block", "part", "side")

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        p = percent / 100

        def held_of(rows: list[tuple]) -> tuple:
            numbers = np.array([r[:4] for r in rows], dtype=np.int64)
            return (*numbers.T, np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1))

        def alike(held: tuple, rows: list[tuple], row: tuple) -> Iterable[tuple]:
            ids, components, sizes, common, signatures = held
            doc_id, component, n, shared, sig, short = row
            most = np.minimum(common, shared)
            at = np.flatnonzero((components != component) & (most * 100 >= (sizes + n - most) * percent))
            if not at.size:
                return
            agree = (signatures[at] == np.frombuffer(sig, np.uint8)).mean(axis=1)
            at = at[agree >= p - 5 * (p * (1 - p) / signatures.shape[1]) ** 0.5]
            own = unpack_short(short) if at.size else None
            for k in at.tolist():
                if isinstance(rows[k][5], bytes):
                    rows[k] = (*rows[k][:5], unpack_short(rows[k][5]))
                both = _at_most_common(rows[k][5], own)
                if 100 * both >= percent * (int(sizes[k]) + n - both):
                    yield min(doc_id, rows[k][0]), max(doc_id, rows[k][0])

        def among(rows: list[tuple], held: tuple) -> Iterable[tuple]:
            """Pairs of one block's own rows, when the block is the whole band."""
            for k in range(1, len(rows)):
                yield from alike(tuple(x[:k] for x in held), rows, (*rows[k][:5], whole_short[k]))

        key, rows, held, whole_short = None, [], None, []
        for band, block, part, side, *row in stream:
            if (band, block, part) != key:
                if rows and held is None and whole_short:
                    yield from among(rows, held_of(rows))
                key, rows, held, whole_short = (band, block, part), [], None, []
            if side < 2:
                rows.append(tuple(row))
                if side == 1:
                    whole_short.append(row[5])
                continue
            if held is None:
                if not rows:
                    continue
                held = held_of(rows)
                if whole_short:
                    yield from among(rows, held)
            yield from alike(held, rows, tuple(row))
        if rows and held is None and whole_short:
            yield from among(rows, held_of(rows))

    return arrow_rows(dealt, ["band", "block", "part", "side", "doc_id", "component", "n_shingles", "shared", "sig", "short"], run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links) per document of (doc_id, text).

    ``n_links`` counts the confirmed links of the document's representative that were needed to
    find the component; it is at least 1 exactly if the document is linked to another document.
    """
    found = components(keyed(docs, nulls_last=True), width, percent, rows, bands)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("key") == F.col("root"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"), "n_links")


def components(plain: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, key, n_shingles, root, component_id, n_links) per row of ``keyed`` documents (id, key, text):
    ``root`` is the smallest key of the component and ``component_id`` its id."""
    spark: SparkSession = plain.sparkSession
    steps = Steps(spark, "near-dup")
    docs = plain.select(F.col("key").alias("doc_id"), "id", "text")
    sketched = steps.save(sketches(docs, width, rows, bands), "sketches")
    sets = sketched.where("set_key is not null")
    first = sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "id")).alias("rep"), F.count("*").alias("copies"))
    first = first.select("set_key", F.col("rep.doc_id").alias("rep"), F.col("rep.id").alias("rep_id"), "copies")
    # Only representatives with a set of their own take part from here on.
    single = sets.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = single.select("doc_id", F.explode("bands").alias("band"))
    in_common = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    met = steps.save(banded.join(in_common, "band"), "met")
    sharing = met.select("doc_id").distinct()
    texts = steps.save(_packed_texts(docs.select("doc_id", "text").join(sharing, "doc_id", "left_semi")), "texts")
    few = steps.save(
        sketched.select("doc_id", "n_shingles", "sig").join(texts.select("doc_id"), "doc_id", "left_semi")
        .join(_private_counts(texts, width), "doc_id", "left")
        .withColumn("shared", F.col("n_shingles") - F.coalesce("private", F.lit(0)))
        # A text with more private shingles than this is like no other text.
        .where(F.col("shared") * 100 >= F.col("n_shingles") * percent), "members",
    )
    # One row per document with the bands it shares, at most ``bands`` of them.
    members = steps.save(
        few.withColumn("private", F.col("n_shingles") - F.col("shared"))
        .join(met.groupBy("doc_id").agg(F.collect_list("band").alias("bands")), "doc_id"), "in-bands")
    steps.drop(met)
    buckets = members.select("doc_id", "private", F.explode("bands").alias("band"))

    # First round: each member meets the pivot of its buckets that has the least of its own.
    pivots = buckets.groupBy("band").agg(F.min(F.struct("private", "doc_id")).alias("pivot"))
    best = buckets.join(pivots, "band").groupBy("doc_id").agg(F.min("pivot").alias("pivot"))
    tried = steps.save(_new_pairs(best.select(F.col("pivot.doc_id").alias("u"), F.col("doc_id").alias("v")), None), "pairs")
    links = steps.save(confirm(tried, texts, width, percent).select("u", "v"), "links")
    before = buckets.groupBy("band").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    turn = 1
    while True:
        component = steps.save(connected_components(links, steps).withColumnRenamed("node", "doc_id"), "component")
        # A band whose members are one component stays so: only open bands are kept.
        here = steps.save(
            members.join(component, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "here")
        placed = here.select("doc_id", "component", F.explode("bands").alias("band"))
        sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
        open_bands = steps.save(
            sizes.groupBy("band").agg(
                F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count("*").alias("c"),
                F.max(F.struct("n", "component")).alias("largest")).where("c > 1"), "open")
        left = open_bands.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()[0] or 0
        if not left:
            steps.drop(here, open_bands)
            final = component
            break
        last = left > before / 2
        if last:
            # Pivots no longer settle most of the pairs: compare the signatures of all that is left.
            promising = _left_over(here, open_bands, texts, width, percent, steps)
        else:
            # The pivot of a bucket is its smallest member by a hash that changes every round.
            order = F.struct(F.xxhash64("doc_id", F.lit(turn)), F.col("doc_id"), F.col("component"))
            pivot = placed.groupBy("band").agg(F.min(order).alias("p")).select("band", F.col("p.doc_id").alias("u"), F.col("p.component").alias("pc"))
            proposed = placed.join(pivot, "band").where("component <> pc").select("u", F.col("doc_id").alias("v"))
            proposed = steps.save(_new_pairs(proposed, tried), "pairs")
            promising = _promising(proposed, few, percent)
        new = steps.save(_new_pairs(promising, tried), "promising")
        links, old = steps.save(links.unionAll(confirm(new, texts, width, percent).select("u", "v")), "links"), links
        steps.drop(component, here, open_bands, old, *([] if last else [proposed]))
        if last:
            steps.drop(new)
            final = connected_components(links, steps).withColumnRenamed("node", "doc_id")
            break
        tried, old = steps.save(tried.unionAll(new), "tried"), tried
        steps.drop(new, old)
        before, turn = left, turn + 1
    steps.drop(tried, texts, few, members)
    component = final.withColumnRenamed("doc_id", "rep")
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    ids = sketched.select(F.col("doc_id").alias("component"), F.col("id").alias("root_id"))
    about = steps.save(component.join(degree, "rep").join(ids, "component"), "about")
    copied = first.where("copies > 1").select(F.col("set_key").alias("k"), "rep", "rep_id")
    result = (
        sketched.select("doc_id", "id", "n_shingles", "set_key").join(copied, F.col("set_key") == F.col("k"), "left")
        .withColumns({"has_copies": F.col("rep").isNotNull().cast("int"), "rep_id": F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("rep_id"))})
        .withColumn("rep", F.coalesce("rep", "doc_id")).join(about, "rep", "left")
    )
    linked = F.col("component").isNotNull()
    return result.select(
        "id", F.col("doc_id").alias("key"), "n_shingles", F.coalesce("component", "rep").alias("root"),
        F.when(linked, F.col("root_id")).otherwise(F.col("rep_id")).alias("component_id"),
        (F.coalesce("n_links", F.lit(0)) + F.col("has_copies")).alias("n_links"),
    )


def _new_pairs(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    fresh = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return fresh if tried is None else fresh.join(tried, ["u", "v"], "left_anti")
