"""SimHash near-duplicates through fuzzy keys of the binary Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect
[23, 12] code. Every word lies within three bits of one codeword; its neighbours are the codewords
within four bits, at most six. If two words differ in one bit or not at all, the nearest codeword of
the one is among the neighbours of the other. Three differing bits spread over three segments so
that either some segment is equal and another differs in one bit at most, or each differs in one.
So fingerprints meet under these keys:

* one segment as it is and the codeword of another (six ordered pairs),
* the codewords of all three.

One of a pair gives nearest codewords, the other neighbours; in the second family the first segment
swaps these roles, which keeps the number of keys at about seventy per fingerprint. Keys are joined by
sorting, and candidates are verified on the whole fingerprints.

Only different fingerprints take part: copies meet in the aggregation before. Candidates under one
key are compared in arrays inside a task and merged there at once, so a key that holds a large group
leaves edges in proportion to its fingerprints, not to their pairs, while no link is lost for the
components. A key with more than ``LARGE_GROUP`` rows is not compared in its task, nor held there: its rows go
to a further round under finer keys. Of four parts of the bits that are not known to be equal yet, one is
equal wherever three bits differ at most, so a row gets four keys, and three quarters of those bits go on.
Sixteen such bits are left after five rounds at most, which leaves 65,536 fingerprints a group.

Edge cases: a null or blank text has fingerprint zero and links like any other; texts of one or two words are one
shingle; repeated rows are copies; rows with a null id take part and get the component's smallest id,
null if it has none; an empty table gives an empty table. Other columns are not read by ``near_duplicates``
and are kept by ``representatives``.
"""

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, append_columns, id_and_text, with_columns, written
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Segments as (lowest bit, bits).
SEGMENTS = [(42, 22), (21, 21), (0, 21)]
#: Fixed: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
RADIUS = 4
SMALL_GROUP = 64
LARGE_GROUP = 1 << 15
#: Bits not known to be equal at which a group is compared whatever its size.
FEW_BITS = 16
_FLIP = np.uint64(1 << 63)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())),
        np.uint64, n - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def _signed(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def with_fingerprints(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with its fingerprint as a signed 64-bit column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield with_columns(batch, **{name: pa.array(_signed(found))})

    return append_columns(docs, f"`{name}` bigint", run)


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error to the nearest codeword, errors to all neighbours, and how many.

    Built from the generator polynomial: a codeword is a multiple of it, a syndrome the remainder.
    """
    syndrome_of_bit = []
    for bit in range(23):
        value = 1 << bit
        for high in range(22, 10, -1):
            if value >> high & 1:
                value ^= GENERATOR << (high - 11)
        syndrome_of_bit.append(value)
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + 1):
        for bits in combinations(range(23), weight):
            syndrome = error = 0
            for bit in bits:
                syndrome ^= syndrome_of_bit[bit]
                error |= 1 << bit
            errors[syndrome].append(error)
    counts = np.array([len(e) for e in errors])
    table = np.array([e + e[:1] * (int(counts.max()) - len(e)) for e in errors], dtype=np.int64)
    return table[:, 0], table, counts


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the upper twelve and of the lower eleven bits."""
    upper = np.arange(1 << 12, dtype=np.int64) << 11
    for high in range(22, 10, -1):
        upper ^= (upper >> high & 1) * (GENERATOR << (high - 11))
    return upper, np.arange(1 << 11, dtype=np.int64)


def syndrome(words: np.ndarray) -> np.ndarray:
    upper, lower = _syndromes()
    return upper[words >> 11] ^ lower[words & 0x7FF]


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (the twelve information bits) of the nearest codeword."""
    return (words ^ golay()[0][syndrome(words)]) >> 11


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices of all codewords within the radius."""
    _, table, counts = golay()
    s = syndrome(words)
    n = counts[s]
    rows = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, (words[rows] ^ table[s[rows], at]) >> 11


def keys(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, keys, whether the key comes from neighbours) of unsigned fingerprints.

    The upper bits of a key name its family, so keys of two families never meet.
    """
    parts = [(fps >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1) for low, bits in SEGMENTS]
    near = [nearest(p) for p in parts]
    lists = [neighbours(p) for p in parts]
    every = np.arange(len(fps))
    for family, (i, j) in enumerate(permutations(range(len(parts)), 2)):
        yield every, family << 34 | parts[i] << 12 | near[j], False
        rows, index = lists[j]
        yield rows, family << 34 | parts[i][rows] << 12 | index, True
    family = 6 << 36
    rows, index = lists[0]
    yield rows, family | index << 24 | near[1][rows] << 12 | near[2][rows], False
    rows, second = lists[1]
    counts = np.bincount(lists[2][0], minlength=len(fps))
    first = np.cumsum(counts) - counts
    repeat = counts[rows]
    at = np.arange(int(repeat.sum())) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    both = np.repeat(rows, repeat)
    third = lists[2][1][first[both] + at]
    yield both, family | near[0][both] << 24 | np.repeat(second, repeat) << 12 | third, True


def fuzzy_keys(fingerprints: DataFrame) -> DataFrame:
    """key, fp, near: every fingerprint under all its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fps = batch.column("fp")[start : start + 4096].to_numpy(zero_copy_only=False)
                for rows, key, near in keys(fps.view(np.uint64)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(fps[rows]), pa.array(np.full(len(rows), near))], names=["key", "fp", "near"])

    return fingerprints.select("fp").mapInArrow(run, "key bigint, fp bigint, near boolean")


class Forest:
    """Union-find over fingerprints, for the links found in one task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def _link_large(fps: np.ndarray, bits: int, forest: Forest) -> None:
    """All links of one large group, without its pairs: a fingerprint is compared with those only that
    are not in its component yet, and a dense group soon is one component."""
    fps = np.unique(fps)
    roots = np.arange(len(fps))
    for i in range(len(fps)):
        others = np.flatnonzero(roots != roots[i])
        if not len(others):
            break
        hit = others[_distance(fps[others], fps[i : i + 1]) <= bits]
        if len(hit):
            merged = np.unique(np.append(roots[hit], roots[i]))
            for r in merged[1:].tolist():
                forest.join(int(fps[merged[0]]), int(fps[r]))
            roots[np.isin(roots, merged)] = merged[0]


def links_of(key: np.ndarray, fp: np.ndarray, near: np.ndarray, bits: int, forest: Forest) -> None:
    """Join in ``forest`` all fingerprints that share a key and differ in at most ``bits`` bits.

    Rows are sorted by key. Small groups are compared all at once, shifted against themselves.
    """
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    for start, size in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
        _link_large(fp[start : start + size], bits, forest)
    left = np.repeat(sizes, sizes)
    position = np.arange(len(key)) - np.repeat(starts, sizes)
    rows = np.flatnonzero((left > 1) & (left <= SMALL_GROUP))
    shift = 1
    while len(rows):
        rows = rows[position[rows] + shift < left[rows]]
        a, b = rows, rows + shift
        hit = (near[a] != near[b]) & (fp[a] != fp[b])
        a, b = a[hit], b[hit]
        close = _distance(fp[a], fp[b]) <= bits
        for x, y in zip(fp[a[close]].tolist(), fp[b[close]].tolist()):
            forest.join(x, y)
        shift += 1


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several 64-bit arrays."""
    value = np.zeros(len(parts[-1]), dtype=np.uint64)
    for part in parts:
        value = (value ^ part.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def finer_keys(large: DataFrame) -> DataFrame:
    """key, fp, near, mask: rows of large groups under four keys each, ``mask`` with the bits that may still differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, near, masks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "near", "mask"))
            for mask in np.unique(masks).tolist():
                rows = np.flatnonzero(masks == mask)
                places = [bit for bit in range(64) if mask >> bit & 1]
                for part in np.array_split(places, MAX_BITS + 1):
                    equal = np.array([sum(1 << int(bit) for bit in part)], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(_mixed(key[rows], equal.repeat(len(rows)), fp[rows] & equal)), pa.array(fp[rows]),
                        pa.array(near[rows]), pa.array((mask & ~equal).repeat(len(rows))),
                    ], names=["key", "fp", "near", "mask"])

    return large.mapInArrow(run, "key bigint, fp bigint, near boolean, mask bigint")


def _compared(keyed: DataFrame, bits: int, limit: int) -> DataFrame:
    """Edges a, b with a null ``mask``, and the rows of large groups: a is the fingerprint, b the key."""
    schema, names = "a bigint, b bigint, near boolean, mask bigint", keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, passed = Forest(), [], None

        def rows(key, fp, near, mask) -> Iterator[pa.RecordBatch]:
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(key), pa.array(near), pa.array(mask)], names=["a", "b", "near", "mask"])

        def finish(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Link the whole groups given; rows of large ones are passed on."""
            key = columns[0]
            if len(key):
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                sizes = np.diff(np.append(starts, len(key)))
                large = np.repeat(sizes > limit, sizes) & (np.bitwise_count(columns[3].view(np.uint64)) > FEW_BITS)
                yield from rows(*[c[large] for c in columns])
                links_of(*[c[~large] for c in columns[:3]], bits, forest)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if len(columns) == 3:
                columns.append(np.full(batch.num_rows, -1, dtype=np.int64))
            if passed is not None:
                # The key of a large group goes on.
                cut = int(np.searchsorted(columns[0], passed, side="right"))
                yield from rows(*[c[:cut] for c in columns])
                columns = [c[cut:] for c in columns]
                if not len(columns[0]):
                    continue
                passed = None
            # The last key of a batch may go on in the next one.
            cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
            if cut:
                yield from finish([np.concatenate(c) for c in zip(*held, [c[:cut] for c in columns])])
                held = [[c[cut:] for c in columns]]
            else:
                held.append(columns)
            if sum(len(h[0]) for h in held) > limit:
                columns = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
                yield from finish([c[:cut] for c in columns])
                held = [[c[cut:] for c in columns]]
                if len(columns[0]) - cut > limit and int(np.bitwise_count(columns[3][-1:].view(np.uint64))[0]) > FEW_BITS:
                    yield from rows(*held.pop())
                    passed = columns[0][-1]
        if held:
            yield from finish([np.concatenate(c) for c in zip(*held)])
        found = [(x, forest.root(x)) for x in list(forest.parent)]
        found = [(x, r) for x, r in found if x != r]
        for start in range(0, len(found), 100_000):
            a, b = zip(*found[start : start + 100_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.bool_()), pa.nulls(len(a), pa.int64())],
                names=["a", "b", "near", "mask"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def links(fingerprints: DataFrame, bits: int = MAX_BITS, limit: int = LARGE_GROUP) -> DataFrame:
    """a, b: edges whose components are those of all links between fingerprints.

    Groups of over ``limit`` rows go to finer keys, in at most five further rounds; each round ends in a table.
    """
    if bits > MAX_BITS:
        raise ValueError("the keys are complete for up to three differing bits")
    found = written(_compared(fuzzy_keys(fingerprints), bits, limit), "links")
    edges = found.filter("mask IS NULL").select("a", "b")
    large = found.filter("mask IS NOT NULL")
    while not large.isEmpty():
        found = written(_compared(finer_keys(large), bits, limit), "links")
        edges = edges.unionByName(found.filter("mask IS NULL").select("a", "b"))
        large = found.filter("mask IS NOT NULL")
    return edges


def groups(rows: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """fp, component_id, kept_fp: the smallest id reachable from each fingerprint, and the fingerprint that
    has it (the smallest, if several have). ``rows`` has doc_id and fp."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    labels = components(links(distinct, bits))
    linked = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("first")
    roots = linked.groupBy("root").agg(first)
    return linked.join(roots, "root").select("fp", F.col("first.least").alias("component_id"), F.col("first.fp").alias("kept_fp"))


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    rows = written(with_fingerprints(id_and_text(docs)).drop("text"), "simhash")
    found = groups(rows, bits)
    # One row per fingerprint on the right; copies in a third of all rows are split by adaptive execution.
    return rows.join(found.drop("kept_fp"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, one with the smallest id; columns as they were.

    Of repeated rows of that id one stays; of a component without any id, one row stays. Rows are numbered when they are
    written, so what stays is a list of numbers and texts move once."""
    fp, row = "_simhash_fp", "_simhash_row"
    marked = with_fingerprints(docs.withColumn("text", F.col("text").cast("string")), fp)
    rows = written(marked.withColumn(row, F.monotonically_increasing_id()), "simhash")
    narrow = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(fp).alias("fp"), row)
    found = groups(narrow, bits).filter("fp = kept_fp").select("fp")
    first = narrow.groupBy("fp").agg(F.min_by(row, F.coalesce("doc_id", F.lit(2**63 - 1))).alias(row))
    kept = written(found.join(first, "fp").select(row), "simhash-kept")
    # The list grows with the documents, so it is dealt out at every size and never broadcast.
    return rows.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
