"""Centroid clustering, fill-in-middle and exact duplicates against brute force, with their edge cases."""

import math
import random
import re
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import chunk_recipes, fill_middle, orchard, range_coder

SCHEMA = "doc_id bigint, text string, n string, form string, row string, recipe string"
TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc\n", "a\nb\nc", "é\n日本\n🙂🙃\nx\n", "日本語 テキスト", "with <P> inside\nand more\n",
         "<S>", "a<M>b", "ends in <", "<\nS>\n<P\n>\n", "\r\n\r\n", "x" * 9000, "🙂" * 5000, "ab é\n" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", "z", "w") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, t, None, None, None, None) for i, t in enumerate(TEXTS)]
    rows += [rows[-1], (None, "é\n日本\n🙂🙃\nx\n", *[None] * 4), (None, "only null ids", *[None] * 4), (None, "only null ids", *[None] * 4)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_point_index():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "\n", "é", "日", "🙂", "xyz"]) for _ in range(rng.randrange(40)))
        data = text.encode()
        index = fill_middle.PointIndex(data)
        assert index.points == len(text)
        assert len(index.at) == sum(ord(c) > 127 for c in text)
        for k in range(len(text) + 1):
            byte = len(text[:k].encode())
            assert index.to_byte(k) == byte and index.to_point(byte) == k


def brute_example(doc_id, text, unit, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,rate", [("line", 100), ("char", 100), ("line", 50)])
def test_fill_in_middle(docs, unit, rate):
    made = fill_middle.restore(fill_middle.fill_in_middle(docs, unit, rate=rate))
    got = [tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")) for r in made.collect()]
    want = [(r["doc_id"], *brute_example(r["doc_id"], r["text"], unit, rate), r["text"] or "") for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {"plain", "psm", "spm"} == {g[2] for g in got}


def test_fill_in_middle_digests_and_empty(docs, empty):
    rows = fill_middle.digests(fill_middle.fill_in_middle(docs)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.filter("doc_id IS NOT NULL").collect()}
    assert all(r["restored_sha256"] == sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows if r["doc_id"] is not None)
    assert fill_middle.digests(fill_middle.fill_in_middle(empty)).count() == 0


def brute_copies(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r["text"] or "", []).append(i)
    out = []
    for text, members in groups.items():
        ids = [rows[i]["doc_id"] for i in members]
        known = [i for i in ids if i is not None]
        kept = max(members, key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0))
        out += [(rows[i]["doc_id"], max(known) if known else None, len(members), i == kept, sha256(text.encode()).hexdigest()) for i in members]
    return sorted(out, key=repr)


def copies(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("hashes", [chunk_recipes.two_hashes, lambda c: [F.length(c).cast("bigint") % 7, F.lit(0).cast("bigint")]])
def test_exact_duplicates(spark, docs, empty, hashes):
    """The second hash function stands for many contents at once, so identifiers need their numbers."""
    rng = random.Random(2)
    word = lambda: rng.choice(["lorem", "ipsum. ", "dolor ", "a c", "sit\n", "é "])
    passage = "".join(word() for _ in range(900))
    long = ["".join(word() for _ in range(300)) + passage + str(i % 5) for i in range(12)]
    long += [long[0], long[3], long[3] + "x", passage, passage[:-1], passage[:-1] + "y"]
    more = spark.createDataFrame([(500 + i, t, *[None] * 4) for i, t in enumerate(long)], SCHEMA)
    everything = docs.unionByName(more)
    assert copies(chunk_recipes.exact_duplicates(everything, hashes)) == brute_copies(everything.collect())
    assert copies(chunk_recipes.exact_duplicates(empty, hashes)) == []


def test_chunks_join_to_the_text(spark):
    rng = random.Random(9)
    letters = "aeiounlrstdcmpgfbé🙂"
    base = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(6000))
    df = spark.createDataFrame([(base,), ("shifted by this much " + base,), ("x" * 10000,), ("",)], "text string")
    lists = [r[0] for r in df.select(chunk_recipes.chunks_of(F.col("text"))).collect()]
    assert ["".join(c) for c in lists] == [r[0] for r in df.collect()]
    assert all(len(c) <= 4096 for chunks in lists for c in chunks)
    assert len(set(lists[0]) & set(lists[1])) > 0.8 * len(lists[0])


def test_one_group_holds_most_rows(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("copy. "), F.lit(400)))
                                  .otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = chunk_recipes.exact_duplicates(df)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 4000 AND keep_id = 5999").count() == 4000


def brute_clusters(rows, k=16, rounds=3):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(64 * Fraction(x)) for x in v]))
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[i]) for x in zip(*members[i])] if i in members else c for i, c in enumerate(centroids)]
    final = [(vec_id, *nearest(v)) for vec_id, v in kept]
    inertia = {}
    for _, d, c in final:
        inertia[c] = inertia.get(c, 0) + d
    fits = lambda n: n if n < 2**63 else None
    return sorted(((vec_id, c, fits(d), fits(inertia[c]), fits(sum(inertia.values())), sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for vec_id, d, c in final), key=repr)


def clusters(df):
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[c] for c in columns) for r in orchard.clusters(df).collect()), key=repr)


def vectors(n, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, 64)) * scale
    return [(i, [float(x) for x in centers[i % 5] + rng.normal(size=64) * scale * 0.3]) for i in range(n)]


EMBEDDINGS = "vec_id bigint, embedding array<double>, cluster string, distance string, h string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], EMBEDDINGS)


def odd_vectors():
    rows = vectors(150)
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [-float("inf")] * 64]
    rows += [(200 + i, v) for i, v in enumerate(bad)]
    rows += [rows[3], rows[3], (None, rows[7][1]), (None, rows[8][1]), (300, [0.0] * 64), (301, [-0.0] * 64)]
    return rows + [(400 + i, rows[11][1]) for i in range(80)]


@pytest.mark.parametrize("name,rows", [
    ("odd", odd_vectors()), ("few", vectors(5)), ("one", vectors(1)), ("none", []),
    ("ties", [(i, [float((i >> (j % 3)) & 1) for j in range(64)]) for i in range(64)]),
    ("wide", vectors(30) + [(90, [1e308] * 64), (91, [-3e9] * 64), (92, [2.0**40] * 64)]),
])
def test_clusters(spark, name, rows):
    assert clusters(table(spark, rows)) == brute_clusters(rows)


def test_float_components(spark):
    rows = [(i, v) for i, v in vectors(60)]
    df = table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert clusters(df) == brute_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_search_skips_centroids():
    """The search is exact and measures fewer distances than there are."""
    rng = np.random.default_rng(3)
    centers = rng.integers(-1000, 1000, size=(40, 8))
    points = centers[rng.integers(0, 40, size=2000)] + rng.integers(-20, 20, size=(2000, 8))
    lists = orchard.Neighbours(centers.tolist())
    at, best, measured = lists.nearest(points)
    every = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert measured < 0.7 * every.size


def test_slots_are_foreseen_as_a_decoder_fills_them():
    """Entries of all positions at once, in 32 bits, are those a table holds that is filled one id after the other."""
    numbers = np.random.default_rng(5)
    for ids in (numbers.integers(0, 3, (4, 500)), numbers.integers(65530, 65536, (3, 300)), np.zeros((2, 40), np.int64), np.full((1, 1), 7)):
        slots = numbers.integers(0, 5, ids.shape).astype(np.int32)
        found = range_coder._guesses(ids.astype(np.int32), slots)
        assert found.dtype == np.int32
        for row, places, entries in zip(ids.tolist(), slots.tolist(), found.tolist()):
            table = {}
            for value, slot, entry in zip(row, places, entries):
                assert entry == table.get(slot, 0)
                guess, sure = entry & 0xFFFF, entry >> 16
                table[slot] = value | min(sure + 1, 3) << 16 if value == guess else value
