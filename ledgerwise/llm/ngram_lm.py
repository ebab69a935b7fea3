"""Trigram language model in an Elias-Fano trie.

Counts: words and the end of each text, over all training texts. Smoothing interpolates with a
Dirichlet prior at each order: p(w | h) = (c(hw) + MU p(w | shorter h)) / (c(h) + MU); unigrams are
(c + 0.5) / (N + 0.5 (V + 1)). Stored are the smoothed probabilities of seen n-grams and the weight
MU / (c(h) + MU) that an unseen continuation of h takes on, both as logarithms in steps of
``STEP``.

Layout: word ids follow the order of 64-bit hashes of the words. Bigrams and trigrams are sorted and
cut into shards of about ``SHARD_TOKENS`` occurrences; a word with more is cut by its successors. A
shard is one file that readers map. A level has monotone pointers (first child of each context) and
the children's ids, made monotone by adding the last value of the context before; both are in Elias-Fano
form. The third word of a trigram is stored as its place among the successors of the second, so its
ids are small. A lookup is a successor search relative to the context's base; it is done for whole
batches of sorted n-grams.

Jobs: count words (pre-aggregated in tasks), write the vocabulary; count trigrams (sorted and merged in
tasks, shuffled as compressed blocks), write the bigram level; look up each trigram's tail there and
write the trigram level; score. Arrow cuts the texts; each chunk of them looks every different word up once and
sorts n-grams as packed places among its ids. Everything grows with the corpus; nothing is capped. The driver holds one row
per shard.

Edge cases: a null text is empty, and an empty text is its end token alone; unknown words have no
context of their own and get the unigram probability of a word never seen; rows with a null id teach;
repeated rows count each time; without training texts every token is unknown; an empty table gives an
empty table; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .common import LOWER_BYTES, drop_written, id_and_text, remainder, remove_folder, slices, written
from .elias_fano import EliasFano
from .store import mapped, write_arrays

MU = 200.0
STEP = 1 / 4096
SEED = 42
SHARD_TOKENS = 1_500_000
SHARD_WORDS = 1 << 19
# Bytes of text handled at once: where words are counted, and where they are looked up.
COUNTED_BYTES = 6_000_000
CHUNK_BYTES = 3_000_000
# Columns are sorted as one integer while they fit into so many bits.
KEY_BITS = 63
UNKNOWN, BEGIN, END, FIRST = 0, 1, 2, 3
FOLDS, HELD_OUT = 5, 1


def tokens(text: str | None) -> list[bytes]:
    """The words of one text; ``Words`` cuts whole columns in the same way."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


class Words:
    """The words of some texts, cut and told apart by Arrow: the different words, the number of each
    token's word among them, and the tokens of each text."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        # White space at the ends of a text leaves empty words.
        empty = pc.index(words, pa.scalar(b"", pa.binary())).as_py()
        if empty >= 0:
            real = codes != empty
            ends = np.append(0, np.cumsum(real))[ends]
            codes = codes[real]
            codes -= codes > empty
            words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
        self.words, self.codes, self.sizes = words, codes, np.diff(ends)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of text; a longer text goes alone."""
    held, so_far = [], 0
    for batch in batches:
        for some in slices(batch, size):
            held.append(some)
            so_far += pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
            if so_far >= size // 2:
                yield pa.concat_batches(held)
                held, so_far = [], 0
    if held:
        yield pa.concat_batches(held)


def code(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10 / STEP), 65535).astype(np.uint16)


def value(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * -STEP


def squeeze(columns: list[np.ndarray]) -> bytes:
    """32-bit columns by byte planes, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(c, dtype="<u4").view(np.uint8)[k::4].copy() for c in columns for k in range(4)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def halves(counts: np.ndarray) -> list[np.ndarray]:
    """64-bit counts as two 32-bit columns."""
    wide = counts.astype(np.int64)
    return [wide & 0xFFFFFFFF, wide >> 32]


def joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | high.astype(np.int64) << 32


def unsqueeze(blob: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return [np.ascontiguousarray(p.reshape(4, -1).T).view("<u4").ravel() for p in raw.reshape(columns, -1)]


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns change."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def merge(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Sorted different trigrams with their summed counts."""
    if not len(a):
        return [a, b, c, n]
    columns, known = [], []
    for column in (a, b, c):
        low = int(column.min())
        columns.append(column - low)
        known.append(low)
    widths = [int(column.max()).bit_length() for column in columns]
    # Ids of a column that is too wide for one key with the others become places among its different ids.
    while sum(widths) > KEY_BITS and any(np.isscalar(k) for k in known):
        widest = max((i for i in range(3) if np.isscalar(known[i])), key=widths.__getitem__)
        ids, columns[widest] = np.unique(columns[widest], return_inverse=True)
        known[widest] = ids + known[widest]
        widths[widest] = (len(ids) - 1).bit_length()
    if sum(widths) > KEY_BITS:
        order = np.lexsort(columns[::-1])
        heads = runs(*(column[order] for column in columns))
        parts = [column[order[heads]] for column in columns]
    else:
        packed = columns.pop(0)
        for width in widths[1:]:
            packed <<= width
            packed |= columns.pop(0)
        order = np.argsort(packed)
        packed = packed[order]
        heads = runs(packed)
        kept = packed[heads]
        parts = [kept >> widths[1] + widths[2], kept >> widths[2] & (1 << widths[1]) - 1, kept & (1 << widths[2]) - 1]
    return [*(x + k if np.isscalar(k) else k[x] for x, k in zip(parts, known)), np.add.reduceat(n[order], heads, dtype=np.int64)]


def count(known: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Sorted different trigrams with their counts, from places in the sorted ids ``known``."""
    bits = len(known).bit_length()
    if 3 * bits > KEY_BITS:
        return merge(known[a], known[b], known[c], np.ones(len(a), dtype=np.int64))
    packed = a << (2 * bits)
    packed |= b << bits
    packed |= c
    packed.sort()
    heads = runs(packed)
    n, kept, low = np.diff(heads, append=len(packed)), packed[heads], (1 << bits) - 1
    return [known[kept >> (2 * bits)], known[kept >> bits & low], known[kept & low], n]


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of up to ``bits`` bits, sorted, and the place of each key among them."""
    place_bits = len(keys).bit_length()
    if bits + place_bits > KEY_BITS:
        return np.unique(keys, return_inverse=True)
    ordered = keys << place_bits
    ordered |= np.arange(len(keys))
    ordered.sort()
    place = ordered & (1 << place_bits) - 1
    ordered >>= place_bits
    heads = runs(ordered)
    back = np.empty(len(keys), dtype=np.int64)
    back[place] = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(keys)))
    return ordered[heads], back


class Vocabulary:
    """Word ids and counts, from mapped files sorted by hash."""

    def __init__(self, facts: dict):
        self.facts = facts
        self.bases = np.array(facts["bases"], dtype=np.int64)
        self.files = [mapped(f"{facts['folder']}/vocabulary-{i}") for i in range(len(facts["bases"]))]
        self.spare = {bytes.fromhex(w): int(self.bases[i]) + at for i, f in enumerate(self.files) for w, at in f.facts["spare"]}
        self.texts, self.total, self.types = facts["texts"], facts["total"], facts["types"]

    def find(self, words: pa.Array) -> np.ndarray:
        import xxhash

        names, hashed = words.to_numpy(zero_copy_only=False).tolist(), xxhash.xxh64_intdigest
        hashes = np.fromiter([hashed(w, SEED) for w in names], np.uint64, len(names))
        ids = np.zeros(len(names), dtype=np.int64)
        # Shards are ranges of the hash; sorted, neighbours are found in the same pages.
        order = np.argsort(hashes)
        hashes = hashes[order]
        shard = shard_of_hash(hashes, len(self.files))
        heads = runs(shard).tolist()
        for head, tail in zip(heads, heads[1:] + [len(shard)]):
            keys = self.files[shard[head]]["hash"]
            if len(keys):
                wanted = hashes[head:tail]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                ids[order[head:tail][hit]] = self.bases[shard[head]] + at[hit]
        if self.spare:
            for i, w in enumerate(names):
                ids[i] = self.spare.get(w, ids[i])
        return ids

    def sequence(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts one after another, each between ``BEGIN`` and ``END``: the different ids, sorted,
        every token's place among them, and the place of each text's beginning."""
        found = np.concatenate([self.find(words.words), [BEGIN, END]])
        known, rank = np.unique(found, return_inverse=True)
        heads = np.cumsum(words.sizes + 2) - words.sizes - 2
        inner = np.ones(len(words.codes) + 2 * len(heads), dtype=bool)
        inner[heads] = inner[heads + words.sizes + 1] = False
        ranks = np.empty(len(inner), dtype=np.int64)
        ranks[inner] = rank[words.codes]
        ranks[heads], ranks[heads + words.sizes + 1] = rank[-2:]
        return known, ranks, heads

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Occurrences; of the end token the number of texts, of an unknown word none."""
        result = np.zeros(len(ids), dtype=np.int64)
        result[(ids == END) | (ids == BEGIN)] = self.texts
        words = np.flatnonzero(ids >= FIRST)
        shard = (np.searchsorted(self.bases, ids[words], side="right") - 1).astype(np.uint16 if len(self.bases) < 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")
        heads = runs(shard[order])
        for rows in np.split(order, heads[1:]) if len(heads) else []:
            s = int(shard[rows[0]])
            result[words[rows]] = self.files[s]["count"][ids[words[rows]] - self.bases[s]]
        return result

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.types + 1))


def shard_of_hash(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash; ``shards`` is a power of two."""
    bits = shards.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """word, n: occurrences over all texts; the empty word counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, COUNTED_BYTES):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            counted = lists.flatten().value_counts()
            word, n = counted.field(0), counted.field(1)
            real = pc.not_equal(word, "")
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([word.filter(real).cast(pa.binary()), pa.array([b""])]),
                 pa.concat_arrays([n.filter(real), pa.array([len(batch)], pa.int64())])], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def write_vocabulary(spark: SparkSession, texts: DataFrame, folder: str) -> dict:
    """Write the vocabulary files; returns the facts that readers need."""
    counted = written(count_words(texts), "words")
    words = counted.filter("word <> x''")
    total = words.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    ends = counted.filter("word = x''").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    shards = 1 << max(0, (total["types"] // SHARD_WORDS).bit_length())
    bits = shards.bit_length() - 1
    shard = F.shiftrightunsigned(F.xxhash64("word"), 64 - bits).cast("int") if bits else F.lit(0)
    # One task per shard; a range of the hash holds an even part of the different words.
    parted = words.select(shard.alias("shard"), "word", "n").repartition(shards, "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for s, (names, counts) in _by_shard(batches, ("word", "n")):
            names = [w for part in names for w in part.to_pylist()]
            counts = np.concatenate([c.to_numpy(zero_copy_only=False) for c in counts])
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in names), np.uint64, len(names))
            order = np.argsort(hashes, kind="stable")
            # Of words with one hash the first is found by it, the others by name.
            first = np.append(True, hashes[order][1:] != hashes[order][:-1])
            spare = order[~first]
            order = order[first]
            spares = [(names[i].hex(), len(order) + k) for k, i in enumerate(spare.tolist())]
            ordered = counts[np.concatenate([order, spare])]
            write_arrays(f"{folder}/vocabulary-{s}", {"hash": hashes[order], "count": ordered.astype(np.int64)}, spare=spares)
            step = max(1, len(ordered) // 256)
            ends = list(range(step, len(ordered), step)) + [len(ordered)]
            mass = np.diff(np.append(0, np.cumsum(ordered)[np.array(ends) - 1]))
            hot = np.flatnonzero(ordered > SHARD_TOKENS)
            yield pa.RecordBatch.from_pylist([{
                "shard": s, "n": len(ordered), "ends": ends, "mass": mass.tolist(), "hot": hot.tolist(), "hot_n": ordered[hot].tolist()}],
                schema=pa.schema([("shard", pa.int32()), ("n", pa.int64())] + [(c, pa.list_(pa.int64())) for c in ("ends", "mass", "hot", "hot_n")]))

    made = {r["shard"]: r for r in parted.mapInArrow(
        run, "shard int, n bigint, ends array<bigint>, mass array<bigint>, hot array<bigint>, hot_n array<bigint>").collect()}
    drop_written(counted)
    bases, at = [], FIRST
    buckets, hot = [(FIRST, 2 * ends)], [(w, ends) for w in (BEGIN, END) if ends > SHARD_TOKENS]
    for s in range(shards):
        bases.append(at)
        if s in made:
            buckets += [(at + e, m) for e, m in zip(made[s]["ends"], made[s]["mass"])]
            hot += [(at + w, n) for w, n in zip(made[s]["hot"], made[s]["hot_n"])]
            at += made[s]["n"]
        else:
            write_arrays(f"{folder}/vocabulary-{s}", {"hash": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64)}, spare=[])
    return {
        "folder": folder, "bases": bases, "texts": int(ends), "total": int(total["n"]) + int(ends),
        "types": int(total["types"]) + (1 if ends else 0), "bounds": _bounds(buckets, hot),
    }


def _by_shard(batches: Iterator[pa.RecordBatch], names: tuple) -> Iterator[tuple[int, list]]:
    """The columns of each shard, from batches sorted by shard."""
    current, held = None, [[] for _ in names]
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        heads = runs(shards).tolist()
        for head, tail in zip(heads, heads[1:] + [len(shards)]):
            if shards[head] != current:
                if current is not None:
                    yield current, held
                current, held = int(shards[head]), [[] for _ in names]
            for h, name in zip(held, names):
                h.append(batch.column(name).slice(head, tail - head))
    if current is not None:
        yield current, held


def _bounds(buckets: list[tuple[int, int]], hot: list[tuple[int, int]]) -> list[int]:
    """First (word << 32 | successor) of each shard, so that each has about ``SHARD_TOKENS`` occurrences."""
    ends = np.array([e for e, _ in buckets], dtype=np.int64)
    mass = np.cumsum([m for _, m in buckets])
    shards = int(mass[-1] // SHARD_TOKENS) + 1
    even = lambda parts: {int(ends[i]) for i in np.searchsorted(mass, mass[-1] * np.arange(1, parts) / parts)}
    cuts = {0} | {e << 32 for e in even(shards)}
    for word, n in hot:
        cuts |= {word << 32, (word + 1) << 32} | {word << 32 | e for e in even(int(n // SHARD_TOKENS) + 1)}
    return sorted(cuts)


def count_trigrams(texts: DataFrame, facts: dict) -> DataFrame:
    """shard, block: sorted trigrams with counts, merged within chunks of a task."""
    sent = texts.sparkSession.sparkContext.broadcast(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        bounds = np.array(sent.value["bounds"], dtype=np.int64)

        for batch in chunks(batches, CHUNK_BYTES):
            known, s, heads = vocabulary.sequence(Words(batch.column("text")))
            # The end is followed by nothing, which has the id zero, so a bigram that ends a text has a trigram too.
            first = np.ones(len(s), dtype=bool)
            first[heads[1:] - 1] = first[-1] = False
            known, s = np.append(0, known), s + 1
            third = np.append(s[2:], [0, 0])
            third[heads[1:] - 2] = 0
            a, b, c, n = count(known, s[first], np.append(s[1:], 0)[first], third[first])
            cuts = np.searchsorted(a << 32 | b, bounds).tolist() + [len(a)]
            rows = [(shard, squeeze([np.diff(a[h:t], prepend=0), b[h:t], c[h:t], n[h:t]]))
                    for shard, (h, t) in enumerate(zip(cuts, cuts[1:])) if t > h]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])

    return texts.select("text").mapInArrow(run, "shard int, block binary")


def _level(context: np.ndarray, contexts: int, ids: np.ndarray) -> tuple[dict, dict]:
    """Arrays of one level: pointers per context, and ids made monotone over the contexts."""
    pointers = np.append(0, np.cumsum(np.bincount(context, minlength=contexts)))
    heads = runs(context)
    tails = np.append(heads[1:], len(context)) - 1
    bases = np.append(0, np.cumsum(ids[tails])[:-1]) if len(heads) else np.zeros(0, dtype=np.int64)
    monotone = ids + np.repeat(bases, np.diff(np.append(heads, len(context))))
    arrays, facts = {}, {}
    for name, values in (("pointers", pointers), ("ids", monotone)):
        encoded, facts[name] = EliasFano.encode(values)
        arrays |= {f"{name}.{field}": v for field, v in encoded.items()}
    return arrays, facts


def write_bigrams(blocks: DataFrame, facts: dict) -> dict:
    """Write the bigram level and, for the next job, the merged trigrams; returns the grown facts."""
    folder, shards = facts["folder"], len(facts["bounds"])
    sent = blocks.sparkSession.sparkContext.broadcast(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, mu = Vocabulary(sent.value), sent.value["mu"]
        for shard, (parts,) in _by_shard(batches, ("block",)):
            columns = [unsqueeze(b, 4) for part in parts for b in part.to_pylist()]
            del parts
            n = np.concatenate([x.pop() for x in columns])
            c, b = (np.concatenate([x.pop() for x in columns], dtype=np.int64) for _ in range(2))
            a, b, c, n = merge(np.concatenate([np.cumsum(x.pop(), dtype=np.int64) for x in columns]), b, c, n)
            del columns
            heads = runs(a, b)
            first, second, pair = a[heads], b[heads], np.add.reduceat(n, heads)
            real = c != 0
            children = np.add.reduceat(real.astype(np.int64), heads)
            words = runs(first)
            own = np.repeat(vocabulary.counts(first[words]), np.diff(np.append(words, len(first))))
            low = int(first[0])
            arrays, levels = _level(first - low, int(first[-1]) - low + 1, second)
            arrays["p"] = code(np.log10((pair + mu * vocabulary.unigram(vocabulary.counts(second))) / (own + mu)))
            arrays["weight"] = code(np.log10(mu / (pair + mu)))
            write_arrays(f"{folder}/bigrams-{shard}", arrays, low=low, contexts=int(first[-1]) - low + 1, levels=levels)
            block = np.frombuffer(squeeze([c[real], *halves(n[real])]), dtype=np.uint8)
            heads_block = np.frombuffer(squeeze([second, children, *halves(pair)]), dtype=np.uint8)
            write_arrays(f"{folder}/trigram-counts-{shard}", {"trigrams": block, "bigrams": heads_block})
            last = int(len(first) - words[-1])
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "first_word": low, "last_word": int(first[-1]), "n_last": last, "n": len(first), "n_trigrams": int(real.sum())}])

    parted = blocks.repartition(shards, "shard").sortWithinPartitions("shard")
    made = {r["shard"]: r for r in parted.mapInArrow(
        run, "shard bigint, first_word bigint, last_word bigint, n_last bigint, n bigint, n_trigrams bigint").collect()}
    # Successors of a word that is cut into several shards are numbered on from the shard before.
    carried, word, so_far = [], None, 0
    for s in range(shards):
        r = made.get(s)
        if r is None:
            carried.append(0)
            continue
        carried.append(so_far if r["first_word"] == word else 0)
        so_far = r["n_last"] + (carried[-1] if r["first_word"] == r["last_word"] else 0)
        word = r["last_word"]
    return facts | {"carried": carried, "full": sorted(made), "bigrams": sum(r["n"] for r in made.values()),
                    "trigrams": sum(r["n_trigrams"] for r in made.values())}


class Level:
    """One mapped level of one shard."""

    def __init__(self, uri: str):
        self.file = mapped(uri)
        levels = self.file.facts["levels"]
        self.pointers, self.ids = (
            EliasFano({f: self.file[f"{name}.{f}"] for f in EliasFano.FIELDS}, **levels[name]) for name in ("pointers", "ids"))

    def find(self, context: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each child and its place among its context's children; -1 if there is none.

        ``context`` is sorted."""
        heads = runs(context)
        wanted = context[heads]
        first, end = self.pointers.with_next(wanted)
        base = np.zeros(len(heads), dtype=np.int64)
        base[first > 0] = self.ids[first[first > 0] - 1]
        repeat = np.diff(np.append(heads, len(context)))
        first, end, base = (np.repeat(x, repeat) for x in (first, end, base))
        at, equal = self.ids.successor(base + child)
        found = equal & (at >= first) & (at < end)
        return np.where(found, at, -1), np.where(found, at - first, -1)


class Trie:
    """All levels of all shards, mapped as they are needed."""

    def __init__(self, facts: dict):
        self.facts = facts
        self.bounds = np.array(facts["bounds"], dtype=np.int64)
        self.full = set(facts["full"])
        self.levels: dict[str, Level] = {}

    def level(self, name: str, shard: int) -> Level:
        key = f"{name}-{shard}"
        if key not in self.levels:
            self.levels[key] = Level(f"{self.facts['folder']}/{key}")
        return self.levels[key]

    def bigrams(self, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
        """shard, at, place, p, weight of sorted bigrams; at is -1 where there is none."""
        size = len(first)
        result = {"shard": np.searchsorted(self.bounds, first << 32 | second, side="right") - 1, "at": np.full(size, -1),
                  "place": np.full(size, -1), "p": np.zeros(size), "weight": np.zeros(size)}
        heads = runs(result["shard"]).tolist()
        for head, tail in zip(heads, heads[1:] + [size]):
            shard = int(result["shard"][head])
            if shard not in self.full:
                continue
            level = self.level("bigrams", shard)
            low, contexts = level.file.facts["low"], level.file.facts["contexts"]
            rows = head + np.flatnonzero((first[head:tail] >= low) & (first[head:tail] < low + contexts))
            at, place = level.find(first[rows] - low, second[rows])
            rows, at, place = rows[at >= 0], at[at >= 0], place[at >= 0]
            result["at"][rows] = at
            result["place"][rows] = place + np.where(first[rows] == low, self.facts["carried"][shard], 0)
            result["p"][rows] = value(level.file["p"][at])
            result["weight"][rows] = value(level.file["weight"][at])
        return result

    def trigrams(self, shard: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there, and probability, of the children at ``place`` of sorted bigrams (shard, at)."""
        found, p = np.zeros(len(shard), dtype=bool), np.zeros(len(shard))
        heads = runs(shard).tolist()
        for head, tail in zip(heads, heads[1:] + [len(shard)]):
            level = self.level("trigrams", int(shard[head]))
            # Places are stored from one on, so that ids ascend strictly.
            hit, _ = level.find(at[head:tail], place[head:tail] + 1)
            rows = head + np.flatnonzero(hit >= 0)
            found[rows] = True
            p[rows] = value(level.file["p"][hit[hit >= 0]])
        return found, p


def write_trigrams(spark: SparkSession, facts: dict) -> None:
    """Write the trigram level of each shard, from the merged trigrams and the bigram level."""
    folder, full = facts["folder"], facts["full"]
    if not full:
        return
    sent = spark.sparkContext.broadcast(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, mu = Trie(sent.value), sent.value["mu"]
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                given = mapped(f"{folder}/trigram-counts-{shard}")
                third, *n = unsqueeze(given["trigrams"].tobytes(), 3)
                second, children, *pair = unsqueeze(given["bigrams"].tobytes(), 4)
                n, pair = joined(*n), joined(*pair)
                context = np.repeat(np.arange(len(second)), children)
                tail = np.repeat(second.astype(np.int64), children) << 32 | third
                del second, third, children
                tails, back = np.unique(tail, return_inverse=True)
                del tail
                found = trie.bigrams(tails >> 32, tails & 0xFFFFFFFF)
                place, p = found["place"][back], found["p"][back]
                del tails, back, found
                arrays, levels = _level(context, len(pair), place + 1)
                arrays["p"] = code(np.log10((n + mu * 10.0**p) / (pair[context] + mu)))
                write_arrays(f"{folder}/trigrams-{shard}", arrays, levels=levels)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], names=["shard"])

    shards = spark.createDataFrame([(s,) for s in full], "shard bigint").repartition(len(full))
    shards.mapInArrow(run, "shard bigint").count()
    for s in full:
        remove_folder(spark, f"{folder}/trigram-counts-{s}")


def train(texts: DataFrame, mu: float = MU) -> dict:
    """Build the model of all ``texts`` in the shared folder; returns what readers need to open it."""
    spark = texts.sparkSession
    folder = new_folder(spark, "ngram-lm")
    facts = write_vocabulary(spark, texts, folder) | {"mu": mu}
    facts = write_bigrams(count_trigrams(texts, facts), facts)
    write_trigrams(spark, facts)
    return facts


class Scorer:
    """log10 probabilities of texts."""

    def __init__(self, facts: dict):
        self.vocabulary, self.trie, self.mu = Vocabulary(facts), Trie(facts), facts["mu"]

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, unigram score, model score."""
        words = Words(texts)
        known, ranks, heads = self.vocabulary.sequence(words)
        bits = len(known).bit_length()
        # Every token but the beginning is scored; its context is the token before.
        scored = np.ones(len(ranks), dtype=bool)
        scored[heads] = False
        third = ranks[scored]
        second = ranks[:-1][scored[1:]]
        sizes = words.sizes + 1
        head = np.cumsum(sizes) - sizes
        counts = self.vocabulary.counts(known)
        unigram_of = np.log10(self.vocabulary.unigram(counts))
        unigram = unigram_of[third]
        weight1 = np.log10(self.mu / (counts + self.mu))
        pairs, pair_of = distinct(second << bits | third, 2 * bits)
        left, right = pairs >> bits, pairs & (1 << bits) - 1
        found = self.trie.bigrams(known[left], known[right])
        there = found["at"] >= 0
        # Of each pair: its probability where it was seen, else that of its second word with the first word's weight.
        score = np.where(there, found["p"], unigram_of[right] + weight1[left])[pair_of]
        # The context of a trigram is the bigram of the token before.
        before = np.append(0, pair_of[:-1])
        inner = there[before]
        inner[head] = False
        score += np.where(inner, found["weight"][before], 0)
        inner &= there[pair_of]
        rows = np.flatnonzero(inner)
        if len(rows):
            bits = len(pairs).bit_length()
            asked, asked_of = distinct(before[rows] << bits | pair_of[rows], 2 * bits)
            left, right = asked >> bits, asked & (1 << bits) - 1
            hit, p = self.trie.trigrams(found["shard"][left], found["at"][left], found["place"][right])
            score[rows] = np.where(hit[asked_of], p[asked_of], score[rows])
        total = lambda x: np.add.reduceat(x, head)
        return {"n_tokens": sizes, "n_known": total((counts > 0)[third].astype(np.int64)), "base_score": total(unigram), "score": total(score)}


def score(docs: DataFrame, facts: dict) -> DataFrame:
    """Per row of ``docs``: doc_id, tokens, known tokens, training tokens, unigram score, model score."""
    sent = docs.sparkSession.sparkContext.broadcast(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)

        for batch in chunks(batches, CHUNK_BYTES):
            found = scorer.score(batch.column("text"))
            total = np.full(len(batch), sent.value["total"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found["n_tokens"], pa.int64()), pa.array(found["n_known"]), pa.array(total),
                 pa.array(found["base_score"]), pa.array(found["score"])],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all of them."""
    rows = id_and_text(docs)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = score(rows, train(rows.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
