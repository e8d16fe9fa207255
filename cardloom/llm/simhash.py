"""SimHash near-duplicates found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.components import components
from cardloom.llm.staging import staged
from cardloom.llm.words import utf8

#: Words in a shingle, seed of its hash, and bits in which linked fingerprints may differ.
SHINGLE, SEED, NEAR = 3, 42, 2
#: Lowest bit and width of the three segments of a fingerprint; each is a 23-bit word with leading zeros.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the perfect binary Golay code of length 23.
GOLAY = 0b101011100011
#: Fingerprints in a bucket that are compared in pairs; those of fuller buckets are linked by the points around them.
PAIRED = 32


def fingerprint(data: bytes) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if it is in over half the shingles' hashes; no words give 0."""
    words = data.lower().split()  # of bytes: A-Z only, and the ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def _syndromes() -> np.ndarray:
    """Remainder of each single bit modulo the generator."""
    found, rest = [], 1
    for _ in range(23):
        found.append(rest)
        rest <<= 1
        if rest >> 11:
            rest ^= GOLAY
    return np.array(found, dtype=np.int64)


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros(words.shape, dtype=np.int64)
    for bit, rest in enumerate(_syndromes()):
        out ^= np.where((words >> bit) & 1, rest, 0)
    return out


def _leaders() -> np.ndarray:
    """For each syndrome its only error pattern of up to three bits."""
    one = 1 << np.arange(23, dtype=np.int64)
    two = (one[:, None] | one).ravel()
    patterns = np.unique(np.concatenate(([0], one, two, (two[:, None] | one).ravel())))
    leaders = np.zeros(1 << 11, dtype=np.int64)
    leaders[_syndrome(patterns)] = patterns
    return leaders


def codeword_indices(segments: np.ndarray) -> np.ndarray:
    """The indices that 23-bit words and all their one-bit neighbours decode to; 24 a row, one or six of them distinct.

    Words that differ in two bits have a common neighbour, so they have a common index.
    """
    near = segments[:, None] ^ np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
    syndromes = _syndrome(segments)[:, None] ^ np.concatenate(([0], _syndromes()))
    return (near ^ _leaders()[syndromes]) >> 11


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the place of the fingerprint that each belongs to.

    Up to two differing bits leave one of three segments as it is. That segment is in the key as it is, together with an
    index of the next segment, which agrees for up to two differing bits. So near fingerprints share a key.
    """
    values = fingerprints.astype(np.uint64)
    parts = [((values >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    keys, places = [], []
    for kind, (exact, fuzzy) in enumerate(zip(parts, parts[1:] + parts[:1], strict=True)):
        indices = np.sort(codeword_indices(fuzzy), axis=1)
        first = np.ones(indices.shape, dtype=bool)
        first[:, 1:] = indices[:, 1:] != indices[:, :-1]
        row, column = np.nonzero(first)
        keys.append((np.int64(kind) << 34) | (exact[row] << 12) | indices[row, column])
        places.append(row)
    return np.concatenate(keys), np.concatenate(places)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(data) for data in utf8(batch.column("text"))], dtype=np.uint64)
        columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=[*names, "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("fp").to_numpy(zero_copy_only=False)
        keys, places = fuzzy_keys(values.view(np.uint64))
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "fp": pa.array(values[places])})


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect all of the distinct fingerprints ``fp`` that differ in up to two bits.

    Buckets of one fuzzy key with few fingerprints are verified pair by pair. A fuller bucket is not: its fingerprints
    give the points at a distance of up to one bit, 65 each. Two of them are near if and only if they share such a
    point, and all that share a point (65 at most) are near each other, so links to the smallest of them connect all.
    """
    keys = staged(distinct.select("fp").mapInArrow(_keys, "key long, fp long"), "fuzzy-keys")
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counts = counts.withColumn("_hash", F.xxhash64("key"))
    shared = keys.withColumn("_hash", F.xxhash64("key")).join(counts, ["key", "_hash"])
    few = shared.where(F.col("n") <= PAIRED).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = lambda a, b: (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= NEAR)
    pairs = F.transform(
        "fps",
        lambda a: F.transform(
            F.filter("fps", lambda b: near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))
        ),
    )
    paired = few.select(F.inline(F.flatten(pairs)))

    full = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    points = full.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    around = points.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
    starred = around.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b"))
    return paired.unionByName(starred).distinct()


def _grouped(rows: DataFrame) -> DataFrame:
    """``fp``, its component's ``root`` and smallest ``component_id`` for rows (``doc_id``, ``fp``)."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(distinct))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left")
    rooted = staged(rooted.select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): its ``fingerprint`` and its group's smallest ``doc_id``.

    Groups are the components of the links between fingerprints that differ in up to two bits. Only distinct fingerprints
    are searched, so copies cost one row each, and a fingerprint links to a bounded number of others.

    Null and empty texts have fingerprint zero, linked like any other. Repeated rows stay. A null ``doc_id`` stays null
    and is no group's id unless all are null. Other columns are not read. An empty table gives none.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")
    rows = staged(rows, "fingerprints")
    groups = _grouped(rows).withColumn("_hash", F.xxhash64("fp"))
    joined = rows.withColumn("_hash", F.xxhash64("fp")).join(groups, ["fp", "_hash"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest ``doc_id`` of their group, one per group, with all their columns."""
    rows = staged(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    kept = _grouped(rows).select(
        F.col("fp").alias("_fp"), F.xxhash64("fp").alias("_hash"), F.col("root").alias("_root"), F.col("component_id").alias("_first")
    )
    schema = "doc_id long, _row struct<" + ",".join(f"_{i}:{f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + ">, fp long"
    packed = docs.select("doc_id", "text", F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)]).alias("_row"))
    marked = packed.mapInArrow(_fingerprints, schema).select("doc_id", "_row", F.col("fp").alias("_fp"), F.xxhash64("fp").alias("_hash"))
    first = marked.join(kept, ["_fp", "_hash"]).where(F.col("doc_id").eqNullSafe(F.col("_first")))
    one = first.dropDuplicates(["_root"])
    return one.select(*[F.col(f"_row._{i}").alias(c) for i, c in enumerate(docs.columns)])
