"""Near-duplicate documents by HyperMinHash sketches, banding, and exact verification.

A document's set is its distinct five-word shingles (fewer words: the whole sequence as one shingle; none: empty). Equal
sets form a class, found by a 128-bit digest; only class representatives go on. Each of REGISTERS buckets keeps the least
hash of the set under its own hash function in compressed form: the number of leading zeros and the MANTISSA bits behind
the leading one, 16 bits in all. BANDS groups of consecutive registers are the keys under which candidates meet.

Candidates are verified in two passes, so that a crowd under one key never costs all its pairs:

1. every member of a key is compared with the key's centre, the member that meets most others over all keys, and
   verified links are joined to components;
2. keys whose members still lie in several components are gone through in parts of bounded size: first by sketches,
   where members that come near none of another component drop out, then, for the others, on full sets, in parts counted
   anew. Each pair is taken under the first key that its members share, and only links leave a task, so that a crowd of
   documents just below the threshold makes no rows. A member travels once for each part of its key: one of BLOCK
   sketches, or of BLOCK_SHINGLES shingles. Then components are joined again.

Before the exact comparison, the Jaccard estimate from equal registers, corrected for registers that agree by chance at
the compressed width, drops pairs that are more than five standard errors below the threshold. A pair exactly at the
threshold shares no key with probability (1 - 0.75**4)**32, or 5e-6; pairs above it less.

Null text counts as empty. Rows without shingles are linked with nothing. Repeated rows share a class; a null id never is
a component's id, and a row with a null id is kept only if no row of its component has an id. An empty table gives no
rows. Only the id and text columns are read, so other columns may have any names; ``keep_one`` keeps them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, written
from .components import components
from .words import Words, as_bytes, mix, segment_sums, slices

SHINGLE = 5
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
PERCENT = 75
#: Standard errors below the threshold at which an estimate rules a pair out.
ERRORS = 5.0
#: Sketches of a key that are compared with one another in one task; a key of more is cut into parts of so many.
BLOCK = 1 << 14
#: The same for full sets, by their shingles.
BLOCK_SHINGLES = 1 << 20

_PLACES = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_FACTORS = mix(np.arange(101, 101 + REGISTERS, dtype=np.uint64)) | np.uint64(1)


# -- sets and sketches ----------------------------------------------------------------------------------------------------


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (repeats included) of all texts in a row, and the number of each text."""
    n = words.counts
    sizes = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    own = words.hashes[words.ids] if len(words.ids) else np.empty(0, np.uint64)
    starts = np.repeat(np.cumsum(n) - n, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = np.repeat(np.minimum(n, SHINGLE), sizes)
    total = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    last = max(len(own) - 1, 0)
    for k in range(SHINGLE):
        part = own[np.minimum(starts + k, last)] * _PLACES[k] if len(own) else own
        total = total + (part if k == 0 else np.where(length > k, part, np.uint64(0)))
    return mix(total), sizes


def registers(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts x REGISTERS of 16 bits; texts without shingles have zeros."""
    out = np.zeros((len(sizes), REGISTERS), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(REGISTERS):
            out[full, k] = compressed(np.minimum.reduceat(hashes * _FACTORS[k], starts))
    return out


def compressed(x: np.ndarray) -> np.ndarray:
    """Leading zeros, then the MANTISSA bits behind the leading one."""
    zeros, rest = np.zeros(len(x), np.uint64), x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = rest < np.uint64(1) << np.uint64(64 - step)
        zeros[small] += np.uint64(step)
        rest[small] = rest[small] << np.uint64(step)
    return ((zeros << np.uint64(MANTISSA)) | ((rest << np.uint64(1)) >> np.uint64(64 - MANTISSA))).astype(np.uint16)


@lru_cache(maxsize=4096)
def _chance(a: int, b: int) -> float:
    """Probability that registers of two unrelated sets of 2**(a/2) and 2**(b/2) members agree."""
    zeros = np.arange(64)[:, None]
    cell = np.arange((1 << MANTISSA) + 1)[None, :]
    edge = 2.0 ** -(zeros + 1.0) * (1 + cell / (1 << MANTISSA))  # lower and upper ends of the cells of [0, 1)
    under = lambda size: -np.expm1(size * np.log1p(-np.minimum(edge, 1 - 1e-16)))  # noqa: E731  P(least hash < edge)
    one, two = under(2 ** (a / 2)), under(2 ** (b / 2))
    return float((np.diff(one, axis=1) * np.diff(two, axis=1)).sum())


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance agreement."""
    level = lambda x: np.rint(2 * np.log2(np.maximum(x, 1))).astype(int).tolist()
    chance = np.array([_chance(a, b) for a, b in zip(level(n), level(m), strict=True)])
    return (equal / REGISTERS - chance) / (1 - chance)


def lowest_estimate() -> float:
    t = PERCENT / 100
    return t - ERRORS * (t * (1 - t) / REGISTERS) ** 0.5


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _th (hash of the text), n, key (digest of the set; null: empty) and sig of every row."""
    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                hashes, sizes = shingles(Words.of(as_bytes(part.column(2)), lower=True))
                sigs = registers(hashes, sizes)
                n, keys, at = [], [], 0
                for size in sizes.tolist():
                    own = np.unique(hashes[at : at + size])
                    at += size
                    n.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if size else None)
                held = [x.tobytes() if s else None for x, s in zip(sigs, sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(held, pa.binary())], names=["_id", "_th", "n", "key", "sig"])

    return slim.mapInArrow(run, f"_id {kind}, _th long, n long, key binary, sig binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(bucket, key) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)  # four registers in a number
            buckets = mix(sigs ^ _SALTS).view(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), batch.column(0).take(pa.array(rows))], names=["bucket", "key"])

    return classes.select("key", "sig").mapInArrow(run, "bucket long, key binary")


# -- verification ---------------------------------------------------------------------------------------------------------


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked: estimated first, then compared on full sets."""
    one = texts.select(F.col("key").alias("a"), F.col("_text").alias("_ta"), F.col("sig").alias("_sa"), F.col("n").alias("_na"))
    two = texts.select(F.col("key").alias("b"), F.col("_text").alias("_tb"), F.col("sig").alias("_sb"), F.col("n").alias("_nb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "_sa", "_sb", "_na", "_nb", "_ta", "_tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            n, m = (batch.column(i).to_numpy() for i in (4, 5))
            may = (estimate((sa == sb).sum(1), n, m) >= lowest_estimate()) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
            if not may.any():
                continue
            left = batch.filter(pa.array(may))
            linked = []
            for part in slices(left, 7, 1 << 21):
                # a text that stands in many rows (a key's least member) is worked on once
                ta, tb = (as_bytes(part.column(i)) for i in (6, 7))
                texts = list(dict.fromkeys([*ta, *tb]))
                number = {x: i for i, x in enumerate(texts)}
                hashes, sizes = shingles(Words.of(texts, lower=True))
                ends = np.cumsum(sizes)
                sets = [np.unique(hashes[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                for x, y in zip(ta, tb, strict=True):
                    p, q = sets[number[x]], sets[number[y]]
                    common = len(p) + len(q) - len(np.union1d(p, q))
                    linked.append(100 * common >= PERCENT * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([left.column(0), left.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def facing_keys(members: DataFrame) -> DataFrame:
    """(bucket, key) of the ``members`` (bucket, key, root, sig, n) whose sketch comes near one of another root, under the
    first bucket that the two share."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts"))
    return _compare(members.join(written(sizes, "sizes"), "bucket"), False).distinct()


def cross_links(members: DataFrame) -> DataFrame:
    """Links (a, b) between different roots under the first bucket they share, on full sets; ``members`` have ``_text``."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("_parts"))
    return _compare(members.join(written(sizes, "sizes"), "bucket"), True).distinct()


def _compare(members: DataFrame, exact: bool) -> DataFrame:
    """Buckets of several parts are cut by hash, and each pair of parts is compared on its own, so that no task holds more
    than two of them at once."""
    own = members.withColumn("_own", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int"))
    spread = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = spread.select("bucket", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "key", "root", "sig", "n", *(["_text"] if exact else []))
    ordered = dealt.repartition(parallelism(members.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key")
    least_equal = lowest_estimate() * REGISTERS  # chance agreement only lowers an estimate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            columns = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bucket", "i", "j")], 1)
            breaks = np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1
            for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), batch.num_rows], strict=True):
                if held and tuple(columns[a]) != group:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                group = tuple(columns[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from compare(pa.Table.from_batches(held))

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        roots = group["root"].to_pylist()
        number = {x: i for i, x in enumerate(dict.fromkeys(roots))}
        if len(number) < 2:
            return
        keys, root = group["key"].to_pylist(), np.array([number[x] for x in roots])
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        bands, bucket = sig.view(np.uint64), group["bucket"][0].as_py()
        here = np.flatnonzero(mix(bands[0] ^ _SALTS).view(np.int64) == bucket)
        size, own = group["n"].to_numpy(), group["_own"].to_numpy()
        lone = group["i"][0].as_py() == group["j"][0].as_py()
        sets = Sets(group["_text"].to_pylist()) if exact else None
        a, b, met = [], [], np.zeros(len(keys), bool)
        for i in range(len(keys) - 1):
            rest = np.arange(i + 1, len(keys))
            rest = rest[(root[rest] != root[i]) & (100 * np.minimum(size[rest], size[i]) >= PERCENT * np.maximum(size[rest], size[i]))]
            if not lone:
                rest = rest[own[rest] != own[i]]
            equal = (sig[rest] == sig[i]).sum(1)
            rest, equal = rest[equal >= least_equal], equal[equal >= least_equal]
            if len(here):
                first = (bands[rest] == bands[i]).argmax(1) == here[0]
                rest, equal = rest[first], equal[first]
            if len(rest):
                rest = rest[estimate(equal, size[rest], np.full(len(rest), size[i])) >= lowest_estimate()]
            if len(rest) and exact:
                common = sets.common(i, rest)
                rest = rest[100 * common >= PERCENT * (size[rest] + size[i] - common)]
                a += [min(keys[i], keys[k]) for k in rest]
                b += [max(keys[i], keys[k]) for k in rest]
            elif len(rest):
                met[rest] = met[i] = True
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        elif met.any():
            found = [keys[k] for k in np.flatnonzero(met)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["bucket", "key"])

    return ordered.mapInArrow(run, "a binary, b binary" if exact else "bucket long, key binary")


class Sets:
    """The shingle sets of a block's texts, as numbers, for counting common members."""

    def __init__(self, texts: list[str]):
        hashes, sizes = shingles(Words.of([t.encode() for t in texts], lower=True))
        ends = np.cumsum(sizes)
        sets = [np.unique(hashes[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        self.sizes = np.array([len(x) for x in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        _, self.members = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.members.max(initial=-1)) + 1, np.int64)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.members[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.mark[own] = 1
        sizes = self.sizes[others]
        at = np.repeat(self.starts[others] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        found = segment_sums(self.mark[self.members[at]], sizes)
        self.mark[own] = 0
        return found


# -- the operator ---------------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id of the component), kept, class_key of every row."""
    rows = written(sketch(docs, id_col, text_col), "sketches")
    classes = written(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("_id").alias("least_id"), F.min(F.struct("_id", "_th")).alias("rep"), F.min("sig").alias("sig"), F.min("n").alias("n")), "classes")
    banded = band_keys(classes)
    crowds = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "crowds")
    members = written(banded.join(crowds, "bucket").select("bucket", "size", "key"), "members")
    meets = written(members.groupBy("key").agg(F.sum("size").alias("meets")), "meets")
    centres = members.join(meets, "key").groupBy("bucket").agg(F.max(F.struct("meets", "key"))["key"].alias("centre"))
    centred = members.join(written(centres, "centres"), "bucket").filter(F.col("key") != F.col("centre"))
    pairs = centred.select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    needed = members.select("key").distinct().join(classes, "key")
    wanted = needed.select("key", F.col("rep._id").alias("_rid"), F.col("rep._th").alias("_th"), "sig", "n")
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    texts = written(source.join(wanted, ["_th"]).filter(F.col("_id").eqNullSafe(F.col("_rid"))).select("key", "sig", "n", "_text").dropDuplicates(["key"]), "texts")
    roots = written(components(verify(pairs, texts)), "roots")
    # second pass
    placed = written(members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root")), "placed")
    mixed = written(placed.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low != _high").select("bucket"), "mixed")
    facing = placed.join(mixed, "bucket").join(classes.select("key", "sig", "n"), "key")
    near = written(facing_keys(facing), "near")
    more = written(cross_links(facing.join(near, ["bucket", "key"]).join(texts.select("key", "_text"), "key")), "more")
    ids = classes.select("key", "least_id").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least_id", F.coalesce("root", "key").alias("root"))
    if not more.isEmpty():  # what the second pass links are whole components of the first
        up = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        between = more.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("_final"))
        ids = ids.join(joined, "root", "left").select("key", "least_id", F.coalesce("_final", "root").alias("root"))
    ids = written(ids, "ids")
    least = written(ids.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = written(ids.join(least, "root").select("key", "component_id"), "named")
    out = rows.join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, component.isNull()).alias("kept"), F.col("key").alias("class_key"), F.col("_th").alias("text_hash"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each component, and one of repeated rows."""
    stay = near_duplicates(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_stay"))
    stay = written(stay.distinct(), "stay")
    hashed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_th"))
    kept = hashed.join(stay, (F.col("_th") == F.col("_stay")) & F.col("_own").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["_own", "_th"]).select("_row.*")
