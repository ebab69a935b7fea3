"""Benchmark decontamination with suffix arrays over the training documents.

Each task builds word-level suffix arrays over shards of its documents: words become integers and
prefix doubling sorts the suffixes by their first twelve words or more. Every suffix of every
benchmark item is searched by bisection, all of them at once. The interval of suffixes that share
its first words gives every place where a window occurs; places on one diagonal of document and
item that follow each other make up the longest verbatim matches. Documents are never cut, so a
match never crosses shards, and nothing is shuffled.

The benchmark goes to the tasks in slices of at most ``SLICE_BYTES`` text; a larger benchmark takes
one pass over the documents per slice, and the marks of the passes are merged per document.

Edge cases: null texts have no words; an item without words has no window; items of fewer words
than a window are one window; equal items (repeated rows) count once per item id, and an item with a
null id carries the id text ``null``; repeated documents are judged one by one; empty tables give
no hits or no rows. ``annotate`` keeps all columns of the documents and adds one column of a name
that they do not use.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, with_columns

WINDOW = 10
SHARD_WORDS = 2_000_000
SLICE_BYTES = 2_000_000
#: Words are runs of ASCII letters, digits and everything beyond ASCII; A-Z is lower-cased.
_TO_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class Suffixes:
    """The suffixes of a sequence of documents, sorted by their first ``depth`` words or more.

    ``ids`` holds the words as integers with a zero after each document; a zero is smaller than any
    word, so a suffix ends where its document ends.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids = ids
        size = len(ids)
        rank, known = ids.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while True:
            if known >= depth or size == 0:
                break
            later = np.zeros(size, dtype=np.int64)
            later[: size - known] = rank[known:] + 1
            key = rank * (int(rank.max()) + 2) + later
            order = np.argsort(key)
            ordered = key[order]
            steps = np.empty(size, dtype=np.int64)
            steps[0] = 0
            np.cumsum(ordered[1:] != ordered[:-1], out=steps[1:])
            rank = np.empty(size, dtype=np.int64)
            rank[order] = steps
            known *= 2
            if steps[-1] == size - 1:
                break
        self.order = order

    def search(self, wanted: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the sorted suffixes that begin with each wanted row's first ``lengths`` words."""
        return self._bisect(wanted, lengths, False), self._bisect(wanted, lengths, True)

    def _bisect(self, wanted: np.ndarray, lengths: np.ndarray, past: bool) -> np.ndarray:
        size = len(self.order)
        low = np.zeros(len(wanted), dtype=np.int64)
        high = np.full(len(wanted), size, dtype=np.int64)
        padded = np.concatenate([self.ids, np.zeros(wanted.shape[1], dtype=self.ids.dtype)])
        while True:
            rows = np.flatnonzero(low < high)
            if not len(rows):
                return low
            middle = (low[rows] + high[rows]) // 2
            at, target, count = self.order[middle], wanted[rows], lengths[rows]
            below = np.zeros(len(rows), dtype=bool)
            equal = np.ones(len(rows), dtype=bool)
            for i in range(wanted.shape[1]):
                here = equal & (i < count)
                if not here.any():
                    break
                word = padded[at + i]
                below |= here & (word < target[:, i])
                equal &= ~here | (word == target[:, i])
            right = below | equal if past else below
            low[rows[right]] = middle[right] + 1
            high[rows[~right]] = middle[~right]


class Shard:
    """Documents as word numbers, each with a zero behind it; words are held once, as keys of ``number``."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.documents: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        number = self.number
        ids = np.zeros(len(words) + 1, dtype=np.int32)
        ids[:-1] = [number.setdefault(w, len(number) + 1) for w in words]
        self.documents.append(ids)
        self.size += len(ids)


class Benchmark:
    """A slice of the benchmark: its items' words, and where each window begins."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.names, words, self.item, self.length, self.place = [], [], [], [], []
        for name, text in items:
            found = words_of(text)
            if not found:
                continue
            for start in range(max(1, len(found) - window + 1)):
                words.append(found[start : start + window])
                self.item.append(len(self.names))
                self.place.append(start)
            self.names.append(name)
        self.words = words
        self.item = np.array(self.item, dtype=np.int64)
        self.place = np.array(self.place, dtype=np.int64)
        self.length = np.array([len(w) for w in words], dtype=np.int64)

    def matches(self, shard: "Shard") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the shard, their windows, and the ends of the documents in it."""
        number, parts = shard.number, shard.documents
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        ends = np.cumsum([len(p) for p in parts])
        # A word that no document has sorts after all of theirs and is equal to none.
        unseen = len(number) + 2
        wanted = np.zeros((len(self.words), self.window), dtype=np.int32)
        for row, words in enumerate(self.words):
            wanted[row, : len(words)] = [number.get(w, unseen) for w in words]
        suffixes = Suffixes(ids, self.window)
        low, high = suffixes.search(wanted, self.length)
        counts = high - low
        hit = np.flatnonzero(counts > 0)
        windows = np.repeat(hit, counts[hit])
        first = np.repeat(low[hit], counts[hit])
        within = np.arange(len(windows)) - np.repeat(np.cumsum(counts[hit]) - counts[hit], counts[hit])
        return suffixes.order[first + within], windows, ends

    def judge(self, shard: "Shard") -> list[dict]:
        """Per document: words, words hit, items found, and its longest verbatim matches."""
        places, windows, ends = self.matches(shard)
        result = [{"n_words": len(ids) - 1, "n_hit": 0, "items": [], "matches": []} for ids in shard.documents]
        if not len(places):
            return result
        starts = ends - np.array([len(ids) for ids in shard.documents])
        change = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + self.length[windows], -1)
        marked = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
        where = np.searchsorted(ends, places, side="right")
        # Windows of one item that follow each other in item and document are one longer match.
        diagonal = places - self.place[windows]
        order = np.lexsort((places, diagonal, self.item[windows], where))
        at, item, line, doc = places[order], self.item[windows][order], diagonal[order], where[order]
        size = self.length[windows][order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (item[1:] != item[:-1]) | (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        for h, t in zip(head.tolist(), tail.tolist()):
            found = result[doc[h]]
            name = self.names[item[h]]
            found["items"].append(name)
            found["matches"].append({
                "item": name, "item_word": int(at[h] - line[h]), "doc_word": int(at[h] - starts[doc[h]]),
                "n_words": int(at[t] - at[h] + size[t])})
        for d in np.unique(doc).tolist():
            result[d]["n_hit"] = int(marked[ends[d]] - marked[starts[d]])
            result[d]["items"] = sorted(set(result[d]["items"]))
        return result


RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,matches:array<struct<item:string,item_word:bigint,doc_word:bigint,n_words:bigint>>>"
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("matches", pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])))])


def benchmark_slices(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The items in slices of at most ``slice_bytes`` of text; an item beyond that is a slice alone."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.col("text").cast("string").alias("text"))
    part, size = [], 0
    for row in rows.toLocalIterator():
        length = len(row["text"] or "")
        if part and size + length > slice_bytes:
            yield part
            part, size = [], 0
        part.append((row["id"], row["text"]))
        size += length
    yield part


def _annotate(docs: DataFrame, items: list, name: str, window: int, shard_words: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Benchmark(sent.value, window)

        def judged(held: list[pa.RecordBatch], shard: Shard) -> Iterator[pa.RecordBatch]:
            found, at = test.judge(shard), 0
            for batch in held:
                yield with_columns(batch, **{name: pa.array(found[at : at + batch.num_rows], _ARROW)})
                at += batch.num_rows

        held, shard = [], Shard()
        for batch in batches:
            # A batch is cut where a shard is full, so a shard has one document beyond its size at most.
            first = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                shard.add(words_of(text))
                if shard.size >= shard_words:
                    yield from judged(held + [batch.slice(first, i + 1 - first)], shard)
                    held, shard, first = [], Shard(), i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield from judged(held, shard)

    return append_columns(docs, f"`{name}` {RESULT}", run)


def annotate(
    docs: DataFrame, benchmark: DataFrame, name: str = "leaks", window: int = WINDOW,
    shard_words: int = SHARD_WORDS, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` with a struct column ``name``: words, words hit, items found, longest matches.

    With several slices hit words are counted once: the passes leave their matches, and the spans
    of all of them are merged within the row.
    """
    df = docs.withColumn("text", F.col("text").cast("string"))
    names = []
    for i, items in enumerate(benchmark_slices(benchmark, slice_bytes)):
        names.append(f"{name}_{i}")
        df = _annotate(df, items, names[-1], window, shard_words)
    if len(names) == 1:
        return df.withColumnRenamed(names[0], name)
    matches = F.flatten(F.array(*[F.col(n)["matches"] for n in names]))
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["doc_word"].alias("first"), (m["doc_word"] + m["n_words"]).alias("end"))))
    merged = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["first"]), F.lit(0).cast("bigint"))).alias("n")),
        lambda a: a["n"])
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(n)["items"] for n in names]))))
    whole = F.struct(F.col(names[0])["n_words"].alias("n_words"), merged.alias("n_hit"), items.alias("items"), matches.alias("matches"))
    return df.withColumn(name, whole).drop(*names)


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, words, words hit, items found, longest match, verdict."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = F.col("leaks")
    longest = F.coalesce(F.array_max(F.transform(found["matches"], lambda m: m["n_words"])), F.lit(0).cast("bigint"))
    return annotate(rows, benchmark, "leaks", window).select(
        "doc_id", found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"), longest.alias("longest_match"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with their columns as they were."""
    name = "_benchmark_leaks"
    return annotate(docs, benchmark, name, window).filter(F.col(name)["n_hit"] == 0).select(*docs.columns)


