"""The text operators against brute force, public libraries and exact round trips, with their edge cases."""

import hashlib
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import (
    byte_bpe, chat_format, components, decontaminate, elias_fano, language_id, ngram_lm, prefix_counts, quality_rules,
    range_coder, secret_scan, simhash,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, score string, fp string"
ODD = [None, "", "   ", "a  b \n c", "日本語 テキスト", "</s> <s>[INST] <0x0A>", "é ﬁ ½", "🙂🙃 x", "tail   ", "x" * 3000, "<|endoftext|> A",
       "ſ İ Σς 'S 'll\n\n  d e", "ab " * 2000]


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "red", "fox", "runs", "over", "long", "green", "hills", "and", "rests"]) + rng.choice(["", "", "ly", "er"])
                    for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, prose, copies, repeated rows, a null id and columns whose names the operators use themselves."""
    texts = ODD + [prose(i) for i in range(20)] + [prose(1)] * 5
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, prose(3), None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def expected(docs, f):
    return sorted(((r["doc_id"], *f(r["text"])) for r in docs.collect()), key=repr)


def test_prefix_counts(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    count = lambda t: len(library.encode(t))
    got = by_id(prefix_counts.token_counts(docs, PIECES, 50), "n_bytes", "n_tokens", "over_limit")
    assert got == expected(docs, lambda t: (len((t or "").encode()), count(t or ""), count(t or "") > 50))
    for r in prefix_counts.token_counts(docs, PIECES, 50).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = r["text"] or ""
        assert count(text[: r["kept_chars"]]) == r["kept_tokens"] <= 50
        assert all(count(text[:n]) > 50 for n in range(r["kept_chars"] + 1, min(len(text), r["kept_chars"] + 30) + 1))
    table = prefix_counts.counter(PIECES)
    for text in ODD:
        short = (text or "")[:60]
        assert prefix_counts.prefix_table(table.deltas(short)).tolist() == [count(short[: i + 1]) for i in range(len(short))]
    assert prefix_counts.token_counts(empty, PIECES).count() == 0


def test_byte_bpe(docs, empty):
    import tiktoken

    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})

    def want(text):
        ids = np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = by_id(byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == expected(docs, want)
    encoded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    decoded = by_id(byte_bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN), "bytes")
    assert [(i, bytes(b)) for i, b in decoded] == [(i, bytes(b)) for i, b in expected(docs, lambda t: (bytearray((t or "").encode()),))]
    assert byte_bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pairs_agree_with_merging():
    from ledgerwise.llm.bpe import Merges

    merges = Merges({t: i for i, t in enumerate("a b c ab bc abc aa aab".split())})
    for left in merges.built:
        for right in merges.built:
            assert merges.compatible(merges.built[left], merges.built[right]) == (merges.merge(left + right) == [left, right])


def test_range_coder(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    files, folder = range_coder.write_ids(docs, WORDS, parts=3)
    got = sorted(range_coder.read_ids(files, folder).collect(), key=lambda r: r["start"])
    ids = {r["text"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda i: -1 if i is None else i)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = 0
    for r in got:
        own = ids[texts[r["doc_id"]]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
        at += len(own)
    assert range_coder.read_ids(*range_coder.write_ids(empty, WORDS, parts=2)).count() == 0


def test_words_looked_up_apart_encode_as_in_whole_texts(monkeypatch):
    """Ids against the library on texts where a cut between words and marks could go wrong."""
    import pyarrow as pa

    monkeypatch.setattr(range_coder, "CHUNK_LIMIT", 20)
    encoder = range_coder.WordEncoder(WORDS)
    assert encoder.plain
    texts = [
        "it's <|endoftext|> x<|startoftext|>y <|endof", "a's b'T c'll?? d,' 'e", "x!'s 's! a!b !!'re ''ll a_b_ a` ~^", "", "  ",
        "\u0130stanbul! \u01c5? e\u0301! \u00e9! na\u00efve-- \ufb01.. \u03a3\u03b1\u03c2. \u00df$ x\u00f7y \u00d7! \u00aa.",
        "\n\n a\n\tb c!\x1cd", "word<|endoftext|> <!", "\u65e5\u672c! 9! \u00bd, a9!", "\u00c0\u00c9\u00df \u00d1and\u00fa! \u00ff? Word word WORD!",
    ]
    wanted = [np.array(e.ids, dtype="<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(pa.array([None, "x", *texts])) == [b"", encoder.known["x"], *wanted]
    assert encoder.encode(pa.array(["x", *texts]).slice(1)) == wanted
    encoder.plain = False
    encoder.known.clear()
    assert encoder.encode(pa.array(texts)) == wanted and encoder.encode(pa.array([], pa.string())) == []


@pytest.mark.parametrize("n", [0, 1, 7, 2048, 5000])
def test_coded_blocks(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 16, n), np.zeros(n), rng.zipf(1.4, n) % 5000):
        packed = range_coder.pack_ids(ids.astype(np.uint16))
        assert (range_coder.unpack_ids(packed) == ids).all()
    if n > 2048:
        packed["words"] = packed["words"].copy()
        packed["words"][9] ^= 4
        with pytest.raises(ValueError):
            range_coder.unpack_ids(packed)


@pytest.mark.filterwarnings("error")
def test_files_keep_their_words():
    """Faster coding writes the words that it wrote before, and a damaged block still fails without a warning."""
    for n, wanted, counts in ((5000, 1174119038, [913, 908, 425]), (300, 3934493226, [161])):
        packed = range_coder.pack_ids((np.random.default_rng(n).zipf(1.4, n) % 5000).astype(np.uint16))
        assert (zlib.crc32(packed["words"].tobytes()), packed["block_words"].tolist()) == (wanted, counts)
        packed["words"] = packed["words"].copy()
        packed["words"][9] ^= 4
        with pytest.raises(ValueError):
            range_coder.unpack_ids(packed)


def test_shares_are_whole_parts():
    """The table of shares against whole numbers, state by state."""
    rng = np.random.default_rng(5)
    for seen in (0, 32, 1792):
        shares = range_coder.Shares(2)
        for _ in range(20 if seen else 0):
            shares.add((rng.integers(0, 2 * 32, seen) * 5 + 1 + rng.integers(0, 4, seen)))
        table = shares.table(seen).reshape(-1, 5).tolist()
        for place, (ends, *kinds) in enumerate(table):
            same = place % 32 >= 16
            least = [1, int(not same), int(seen > 0), 1]
            counts = [int(c) * m for c, m in zip(shares.counts[:, place], least)]
            size = [m + c * (4096 - sum(least)) // sum(counts) for m, c in zip(least, counts)]
            begins = [0, size[0], size[0] + size[1], sum(size[:3])]
            units = [size[0] << 16, size[1] << 16, max((size[2] << 16) // max(seen, 1), 1), 4096 - begins[3]]
            assert ends == begins[1] | begins[2] << 14 | begins[3] << 28
            assert kinds == [b | u << 13 for b, u in zip(begins, units)]


def test_encoding_holds_some_blocks_at_once():
    import tracemalloc

    ids = (np.random.default_rng(1).zipf(1.2, 2048 * 2048) % 50000).astype(np.uint16).reshape(-1, 2048)
    tracemalloc.start()
    words, counts = range_coder.encode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert (range_coder.decode(words, counts, 2048) == ids).all()


def test_files_split_documents(docs, monkeypatch, tmp_path):
    """A document longer than a file goes on in the next one."""
    from ledgerwise.llm.store import Mapped, write_arrays

    ids = np.arange(5000, dtype=np.uint16)
    write_arrays(str(tmp_path / "x"), range_coder.pack_ids(ids))
    assert (range_coder.unpack_ids(Mapped(str(tmp_path / "x")).arrays) == ids).all()


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in [(1, 3), (50, 60), (4000, 10**9), (5000, 40)]:
        values = np.sort(rng.integers(0, top, n))
        arrays, facts = elias_fano.EliasFano.encode(values)
        sequence = elias_fano.EliasFano(arrays, **facts)
        wanted = np.append(rng.integers(0, top + 5, 500), values[:50])
        at, equal = sequence.successor(wanted)
        assert (sequence[np.arange(n)] == values).all()
        assert (at == np.searchsorted(values, wanted)).all() and (equal == np.isin(wanted, values)).all()


def brute_lm(train, text, mu=ngram_lm.MU):
    sequences = [[0, *ngram_lm.tokens(t), 1] for t in train]
    words = Counter(w for s in sequences for w in s[1:])
    total, types = sum(words.values()), len(words)
    pairs = Counter(p for s in sequences for p in zip(s, s[1:]))
    triples = Counter(p for s in sequences for p in zip(s, s[1:], s[2:]))
    context = Counter(words) + Counter({0: len(sequences)})
    context[1] = 0
    uni = lambda w: (words[w] + 0.5) / (total + 0.5 * (types + 1))
    bi = lambda a, w: (pairs[a, w] + mu * uni(w)) / (context[a] + mu)
    s = [0, *ngram_lm.tokens(text), 1]
    score = base = 0.0
    for i in range(1, len(s)):
        p = bi(s[i - 1], s[i])
        if i > 1:
            p = (triples[s[i - 2], s[i - 1], s[i]] + mu * p) / (pairs[s[i - 2], s[i - 1]] + mu)
        score, base = score + log10(p), base + log10(uni(s[i]))
    return base, score, len(s) - 1, sum(words[w] > 0 for w in s[1:]), total


@pytest.mark.parametrize("shard", [1_500_000, 60])
def test_language_model(spark, docs, empty, monkeypatch, shard):
    """Against counting by hand; tiny shards cut frequent words into several files."""
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [r["text"] for r in rows if not held(r["doc_id"])]
    got = {(r["doc_id"], r["n_tokens"]): r for r in ngram_lm.held_out_scores(docs).collect()}
    for r in rows:
        base, score, n, known, total = brute_lm(train, r["text"])
        found = got[r["doc_id"], n]
        assert (found["n_known"], found["train_tokens"], found["held_out"]) == (known, total, held(r["doc_id"]))
        assert found["base_score"] == pytest.approx(base, abs=1e-6)
        assert found["score"] == pytest.approx(score, abs=1e-3 * n + 1e-6)
    assert ngram_lm.held_out_scores(empty).count() == 0


def test_one_word_in_several_bigram_shards():
    bounds = ngram_lm._bounds([(10, 5), (20, 5)], [(3, 10**9)])
    assert bounds == sorted(bounds) and bounds[0] == 0 and 3 << 32 in bounds and 4 << 32 in bounds


def test_quality(docs, empty):
    got = quality_rules.verdicts(docs).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        words = [w for w in texts[r["doc_id"]].replace("\n", " ").split(" ") if w]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(words), len(hit))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.verdicts(empty).count() == 0 and quality_rules.kept_documents(empty).count() == 0


def test_quality_adapts_to_the_source(spark):
    rng = random.Random(4)
    varied = lambda mark: " ".join(f"{mark}w{rng.randint(0, 9999)}" for _ in range(150))
    plain = [(i, varied(""), "en", "a", 0) for i in range(150)]
    marked = [(1000 + i, varied("#"), "en", "b", 0) for i in range(150)]
    odd = [(5000, varied("#"), "en", "a", 0)]
    df = spark.createDataFrame(plain + marked + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality_rules.verdicts(df).filter("kept").collect()}
    assert 5000 not in kept and len(kept & set(range(1000, 1150))) > 140


def test_chat(spark):
    rows = [(1, 0, "user", "hi </s>[INST] \\e \\b"), (1, 1, "assistant", "a]b[c"), (1, 2, "assistant", None), (1, 2, "user", "x"),
            (1, 200, "assistant", "late"), (2, 0, None, None), (None, None, "assistant", "n"), (None, None, "assistant", "n"),
            (3, 5, "role]<x>", "<")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    formatted = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=order)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.examples(formatted).count() == sum(r[2] == "assistant" for r in rows)
    written_out = {(r["conv_id"], r["block"], r["position"]): r for r in chat_format.example_texts(formatted).collect()}
    late = written_out[1, 3, 0]
    assert late["target"] == "[assistant]late</s>" and late["context"].count("</s>") == 4
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_with_one_turn_number(spark, tmp_path):
    """One conversation whose turns all have no number, many of them equal: rows stay small, nothing is lost."""
    rows = [(5, None, ["user", "assistant"][i % 2], f"say {i % 700}" if i % 3 else "same") for i in range(9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    chat_format.format_conversations(df).write.parquet(str(tmp_path / "prefixes"))
    formatted = spark.read.parquet(str(tmp_path / "prefixes"))
    chat_format.examples(formatted).write.parquet(str(tmp_path / "examples"))
    expanded = spark.read.parquet(str(tmp_path / "examples"))
    assert formatted.agg(F.max(F.size("segments"))).head()[0] <= chat_format.BLOCK and expanded.count() == 4500
    got = chat_format.digests(formatted, expanded).head()
    turns = sorted((r[2], r[3]) for r in rows)
    said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    assert (got["n_turns"], got["turns_sha256"]) == (9000, hashlib.sha256(said.encode()).hexdigest())
    assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_examples_hold_their_contexts(spark, tmp_path, monkeypatch):
    """Every example read back from the output holds all turns before it, in long conversations all those of its row."""
    monkeypatch.setattr(chat_format, "WHOLE_CHARS", 4000)
    rows = [(c, t, ["user", "assistant"][(c + t) % 2], f"say [{c}] {t}") for c in range(40) for t in range(c % 9)]
    rows += [(50, t, ["user", "assistant"][t % 2], f"long {t}") for t in range(300)]
    rows += [(60, t, "assistant", "x" * 1500) for t in range(4)] + [(70, t, "assistant", "far") for t in (None, 3, 64, 200, 900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    chat_format.format_conversations(df).write.parquet(str(tmp_path / "prefixes"))
    formatted = spark.read.parquet(str(tmp_path / "prefixes"))
    chat_format.examples(formatted).write.parquet(str(tmp_path / "examples"))
    found = {}
    for r in spark.read.parquet(str(tmp_path / "examples")).orderBy(F.col("block").asc_nulls_first(), "part", "position").collect():
        found.setdefault(r["conv_id"], []).append(r)
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])
        formed = [f"[{role}]{text.replace('[', chr(92) + 'b').replace(']', chr(92) + 'c')}</s>" for _, _, role, text in turns]
        said = [i for i, r in enumerate(turns) if r[2] == "assistant"]
        got = found.get(conv, [])
        assert len(got) == len(said) and all(r["whole"] == (conv not in (50, 60)) for r in got)
        for i, r in zip(said, got):
            before = "".join(formed[:i + 1])
            assert r["text"] == before if r["whole"] else before.endswith(r["text"]) and r["text"].endswith(formed[i])
            assert len(r["text"]) - len("</s>") == r["loss_start"] - 1 + r["loss_chars"]
            if conv == 50:
                assert r["text"].count("</s>") == r["position"] + 1
    whole = {(r["conv_id"], r["block"], r["part"], r["position"]): r["context"] + r["target"] for r in chat_format.example_texts(formatted).collect()}
    last = found[50][-1]
    assert whole[50, last["block"], last["part"], last["position"]].count("</s>") == 300


def brute_components(values, bits):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("limit", [300, 6000, 1 << 15])
def test_simhash_large_group(spark, limit):
    """Fingerprints of one key, sparsely linked: finer keys give the components of a brute-force search."""
    rng = np.random.default_rng(4)
    n = 20_000
    second = np.uint64(int(simhash.nearest(np.array([0]))[0]))
    flip = np.uint64(1) << rng.integers(0, 21, n).astype(np.uint64)
    second = np.where(rng.random(n) < 0.9, flip ^ second, second).astype(np.uint64)
    fps = np.unique(np.uint64(77) << np.uint64(42) | second << np.uint64(21) | rng.integers(0, 1 << 21, n).astype(np.uint64))
    forest = simhash.Forest()
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3).tolist():
            forest.join(int(fps[i]), int(fps[i + 1 + j]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    found = simhash.Forest()
    for row in simhash.links(df, limit=limit).collect():
        found.join(row["a"], row["b"])
    want = [forest.root(int(f)) for f in fps]
    assert len(set(want)) > 100 and [found.root(int(f)) for f in fps] == want


def test_simhash_fingerprints():
    import xxhash

    for text in ["one", "One two", "a b c", "a b c d e a b c", prose(4)]:
        words = text.lower().split()
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for flips in (0, 1, 2, 3):
        y = x.copy()
        for i in range(len(y)):
            for bit in rng.choice(64, flips, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(bit)
        found = []
        for fps in (x, y):
            sides = [[set() for _ in fps], [set() for _ in fps]]
            for rows, keys, near in simhash.keys(fps):
                for r, k in zip(rows.tolist(), keys.tolist()):
                    sides[near][r].add(k)
            found.append(sides)
        assert all(a & b for a, b in zip(found[0][0], found[1][1])) and all(a & b for a, b in zip(found[0][1], found[1][0]))


def test_near_duplicates(spark, docs, empty):
    rows = docs.collect()
    values = [simhash.fingerprint(r["text"]) for r in rows]
    roots = brute_components(values, 3)
    least = {g: min((r["doc_id"] for r, x in zip(rows, roots) if x == g and r["doc_id"] is not None), default=None) for g in set(roots)}
    got = by_id(simhash.near_duplicates(docs), "fingerprint", "component_id")
    assert got == sorted(((r["doc_id"], f"{v:016x}", least[g]) for r, v, g in zip(rows, values, roots)), key=repr)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(x for x in least.values() if x is not None)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0


def test_dense_group_of_fingerprints(spark):
    """Many fingerprints around two centres, and chains between: all links, few edges."""
    rng = np.random.default_rng(5)
    values = {0}
    for centre in (0, 0x0F0F0F0F0F0F0F0F):
        for _ in range(700):
            v = centre
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.groups(df).collect()}
    assert [got[v] for v in signed] == brute_components(values, 3)
    assert simhash.links(df.select("fp")).count() < 80 * len(values)


def test_simhash_keeps_one_of_a_group(spark):
    """Near copies by the query's own contract; exact copies, repeated rows, null ids and texts without words among them."""
    rng = random.Random(8)
    texts = [prose(7000 + i, rng.choice([20, 300, 900])) for i in range(25)]
    for text in texts[:20]:
        words = text.split()
        words[rng.randrange(len(words))] = "edit"
        texts += [text.upper(), " ".join(words)]
    texts += [None, " ", "one two", "One  two", "one two three"]
    rows = [(i + 1, t, "kept", "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "n", "y"), (None, "alone without an id", "n", "y"), (None, "alone without an id", "n", "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, fp string, row string")
    prints = {i: simhash.fingerprint(t) for i, t, _, _ in rows if i}
    roots = brute_components(list(prints.values()), 3)
    least = {}
    for i, root in zip(prints, roots):
        least[root] = min(i, least.get(root, i))
    got = simhash.representatives(df).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"]) == sorted(least.values())
    assert [r["text"] for r in got if r["doc_id"] is None] == ["alone without an id"]
    assert all(r["text"] == texts[r["doc_id"] - 1] for r in got if r["doc_id"]) and df.columns == simhash.representatives(df).columns
    assert simhash.representatives(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (5, 5), (300, 301), (301, 302), (302, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[200] == 100 and got[302] == 300


def brute_leaks(text, items):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for name, item in items:
        own = decontaminate.words_of(item)
        size = min(10, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(name)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0


def test_decontamination(spark, docs, empty):
    passage = prose(50, 30)
    items = [(7, passage), (12, "Short Item here"), (13, None), (14, "!!"), (7, passage), (None, prose(60, 14)), (110, prose(1, 40)), (15, "ab " * 9)]
    more = [(900, "x " + passage + " y short item, HERE z"), (901, prose(60, 14)), (902, passage[: len(passage) // 2]), (903, "short item")]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    names = [("null" if i is None else str(i), t) for i, t in items]
    got = by_id(decontaminate.leak_report(table, benchmark), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == expected(table, lambda t: brute_leaks(t, names))
    for options in ({"shard_words": 50}, {"slice_bytes": 40}):
        leaks = decontaminate.annotate(table, benchmark, "leaks", **options).select("doc_id", "leaks.n_hit", F.size("leaks.items").alias("n"))
        assert by_id(leaks, "n_hit", "n") == sorted(((g[0], g[2], g[3]) for g in got), key=repr)
    kept = decontaminate.clean_documents(table, benchmark)
    assert kept.columns == table.columns and kept.count() == sum(not g[5] for g in got)
    assert decontaminate.leak_report(empty, benchmark).count() == 0
    assert decontaminate.leak_report(table, benchmark.limit(0)).filter("contaminated").count() == 0
    longest = {r["doc_id"]: r["longest_match"] for r in decontaminate.leak_report(table, benchmark).collect()}
    assert longest[900] == 30


def test_language_identification(spark, empty):
    rng = random.Random(1)
    sounds = {"en": "th er on the ing and".split(), "de": "ch ei und der ung sch".split(), "fr": "eau é le que ment oi".split(), "es": "ción ado el que ñ ue".split()}
    say = lambda lang: " ".join("".join(rng.choices(sounds[lang], k=2)) for _ in range(60))
    rows = [(i, say(lang), lang) for i, lang in enumerate(list(sounds) * 60)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 !!", "de"), (None, say("fr"), None), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert found[1000] == found[1001] == found[1002] == "und" and found[None] == "fr"
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[i] == lang for i, _, lang in held) >= 0.97 * len(held)
    one = language_id.identify(df.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in one.collect()} == {"en", "und"}
    assert language_id.identify(empty).count() == 0


def test_secrets(spark, docs, empty):
    rng = random.Random(2)
    secret = "".join(rng.choices("0123456789abcdef", k=40))
    more = [(700, f'{prose(1)} token = "{secret}" {prose(2)}'), (701, f"{prose(3)} commit {secret} {prose(4)}"), (702, f"api_key: {secret.upper()}")]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    found = {(r["doc_id"], r["is_secret"]) for r in secret_scan.findings(table, RANKS).collect()}
    assert {(700, True), (701, False), (702, True)} <= found
    clean = secret_scan.redact(table, RANKS)
    assert clean.columns == table.columns and clean.count() == table.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert secret not in texts[700] and secret_scan.MASK in texts[700] and secret in texts[701]
    assert {i: t for i, t in texts.items() if i is not None and i < 600} == {
        r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    assert secret_scan.findings(empty, RANKS).count() == 0 and secret_scan.redact(empty, RANKS).count() == 0


def test_secrets_assigned_to_long_names(spark):
    key = "ghp_" + "".join(random.Random(4).choices("abcdefghijkXYZ0123456789", k=36))
    lines = {0: ('SPRING_DATASOURCE_PASSWORD: "', "hunter2!x"), 1: ("DATABASE_PASSWORD=", "hunter2!x"), 2: ("GITHUB_TOKEN=", key),
             3: ("spring.datasource.dbPassword = '", "hunter2!x"), 4: ("etc/app/SERVICE_TOKEN_PROD=", "q7#Zk29!mA"), 5: ("AB_PASSWORD_TOKEN: ", key)}
    for before, value in lines.values():
        text = f"see {before}{value}\nthe end"
        assert [text[a:b] for a, b in secret_scan.candidates(text)] == [value]
    run = "x9" * 10
    assert secret_scan.candidates(f"{run} A_TOKEN={key} {run}") == [(0, 20), (29, 69), (70, 90)]
    assert len(secret_scan.candidates("token" * 40_000)) == 1
    df = spark.createDataFrame([(i, f"{prose(i)} {b}{v}\n{prose(i + 50)}", "src") for i, (b, v) in lines.items()], "doc_id long, text string, source string")
    for row in secret_scan.redact(df, RANKS).collect():
        before, value = lines[row["doc_id"]]
        assert value not in row["text"] and before + secret_scan.MASK in row["text"]


def test_secret_forest_on_held_out_findings(spark):
    from ledgerwise.llm import forest

    words = secret_scan.language(RANKS)
    rows = secret_scan.made_findings(1200, seed=9)
    x = np.array([secret_scan.describe(c, b, a, p, words) for c, b, a, p, _ in rows])
    y = np.array([r[4] for r in rows])
    trees = forest.train(spark, x[:800], y[:800], 20)
    assert ((forest.probability(trees, x[800:]) >= 0.5) == y[800:]).mean() > 0.97


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    secret = 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'
    passage = prose(99, 40)
    rows = [(i, prose(i + 200, 150), "en", "a", 0) for i in range(30)]
    rows += [(100, rows[0][1], "en", "a", 0), (101, rows[2][1] + " " + passage, "en", "a", 0), (102, "bad " * 200, "en", "a", 0),
             (103, prose(900, 150) + " " + secret, "en", "a", 0), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {100, 101, 102, 104}.isdisjoint(got) and set(range(30)) <= set(got)
    masked = (prose(900, 150) + " " + secret).replace("9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", secret_scan.MASK)
    assert got[103]["decoded_sha256"] == hashlib.sha256(masked.encode()).hexdigest()


def test_counts_beyond_32_bits():
    counts = np.array([0, 5, 2**32 - 1, 2**32 + 5, 2**40 + 3])
    blob = ngram_lm.squeeze([np.arange(5), *ngram_lm.halves(counts)])
    first, *both = ngram_lm.unsqueeze(blob, 3)
    assert first.tolist() == [0, 1, 2, 3, 4] and ngram_lm.joined(*both).tolist() == counts.tolist()


@pytest.mark.parametrize("doc_id", [7, None])
def test_language_id_of_one_repeated_id(spark, doc_id):
    """One id, or none, over all rows: the draw takes the text in, and no language is left without rows."""
    words = {"en": "the quick house river", "de": "der schnelle fluss haus", "fr": "la maison rapide fleuve"}
    rows = [(doc_id, f"{w} {i % 40}", lang) for lang, w in words.items() for i in range(700)]
    rows += [(doc_id, "il fiume", "it")] * 800
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, 50)
    assert model["langs"] == ["de", "en", "fr", "it"] and len(model["models"]) == 4
    got = language_id.predict(df.dropDuplicates(["text"]), model).collect()
    assert {r["lang_pred"] for r in got} == {"de", "en", "fr", "it"}


def test_letters_are_letters():
    assert not any(language_id.has_letter(t) for t in [None, "", "½", "²", "Ⅷ ①", "12_3 !", "٣"])
    assert all(language_id.has_letter(t) for t in ["a", "½ b", "Ⅷ é", "日", "ª"])


def test_quality_columns_of_any_name(spark):
    names = ["_lang", "_source", "min_symbols", "max_word_length", "_quality_measures", "_QUALITY_kept", "_quality_measures_bounds"]
    rows = [(i, prose(i, 120), "en", "a", *["x"] * len(names)) for i in range(12)] + [(50, "short", None, None, *[None] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    got = quality_rules.kept_documents(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == list(range(12))


def test_words_of_columns_are_those_of_single_texts():
    """Arrow cuts a whole column as ``tokens`` does one text, and lists every word once."""
    import pyarrow as pa

    texts = ["A bÀ a", None, "", " \t\n\x0b\x0c\r ", "  x\x1cy z  q\x85 ", "İı Σ KK", "a" * 9, "\x00 \x1f a", "B"]
    for column in (pa.array(texts), pa.array(["no", *texts, "no"]).slice(1, len(texts)), pa.array(["b a"] * 3), pa.array([""])):
        words = ngram_lm.Words(column)
        wanted = [ngram_lm.tokens(t) for t in column.to_pylist()]
        names = words.words.to_pylist()
        assert [names[i] for i in words.codes] == [w for line in wanted for w in line]
        assert words.sizes.tolist() == [len(line) for line in wanted] and len(set(names)) == len(names)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for size in (1, 8, 1000):
        assert [t for part in ngram_lm.chunks(iter([batch, batch.slice(3)]), size) for t in part.column("text").to_pylist()] == texts + texts[3:]


@pytest.mark.parametrize("bits", [63, 30, 12, 3])
def test_trigrams_counted_in_keys_of_any_width(monkeypatch, bits):
    """One packed key, ids replaced by places, or columns apart: the same trigrams and counts."""
    monkeypatch.setattr(ngram_lm, "KEY_BITS", bits)
    rng = np.random.default_rng(bits)
    known = np.unique(rng.integers(0, 1 << 40, 60))
    a, b, c = (rng.integers(0, len(known), 3000) for _ in range(3))
    a[:2000], b[:2000] = a[0], b[0] % 7
    wanted = Counter(zip(known[a].tolist(), known[b].tolist(), known[c].tolist()))
    once = ngram_lm.count(known, a, b, c)
    assert list(zip(*(x.tolist() for x in once))) == [(*k, n) for k, n in sorted(wanted.items())]
    twice = ngram_lm.merge(*(np.concatenate([x, x[::-1]]) for x in once))
    assert list(zip(*(x.tolist() for x in twice))) == [(*k, 2 * n) for k, n in sorted(wanted.items())]
    keys, places = ngram_lm.distinct(known[a], 40)
    assert (keys == np.unique(known[a])).all() and (keys[places] == known[a]).all()


def test_elias_fano_runs_and_neighbours():
    """Runs of one high part over several words, and a value together with the next one."""
    rng = np.random.default_rng(7)
    for values in (np.concatenate([rng.integers(10**6, 10**6 + 4000, 3000), rng.integers(0, 10**9, 500)]), np.zeros(300), np.arange(0, 10**7, 9973)):
        values = np.sort(values.astype(np.int64))
        arrays, facts = elias_fano.EliasFano.encode(values)
        sequence = elias_fano.EliasFano(arrays, **facts)
        here, after = sequence.with_next(np.arange(len(values) - 1))
        assert (here == values[:-1]).all() and (after == values[1:]).all()
        wanted = np.concatenate([values, values + 1, values // 2, [10**10]])
        at, equal = sequence.successor(wanted)
        assert (at == np.searchsorted(values, wanted)).all() and (equal == np.isin(wanted, values)).all()


def test_words_and_marks_are_known_apart():
    """A word is merged once, whatever its case and the marks behind it, and kept once."""
    import pyarrow as pa

    encoder = range_coder.WordEncoder(WORDS)
    texts = ["Word word! WORD?! Été, étÉ été?! x1", "word, 's été. ÉTÉ! !"]
    wanted = [np.array(e.ids, dtype="<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(pa.array(texts)) == wanted
    assert set(encoder.known) == {"word", "été", "", "!", "?!", ",", ".", "x1", "'s"}
