"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is what is assigned to a name that speaks of a secret, wherever in the name, or any other run of
sixteen or more characters that keys, tokens and hashes are written in. The forest judges it by its length, the classes
of its characters and the transitions between them, how far words of a dictionary cover it, whether
it or the document's path looks like a path or a test, and the words around it.

It is trained from labelled findings: a table (candidate, before, after, path, secret) given by the
caller, or ``default_findings``: findings made by rule in public formats, and findings from at most
``SAMPLE_DOCUMENTS`` documents of the corpus, labelled where the words next to them leave no doubt.
All documents are scanned whole.

Edge cases: null and empty texts have no findings; a null path is empty; repeated rows are scanned
one by one; overlapping candidates are one finding each from left to right; an empty table gives an
empty table. ``redact`` keeps the columns of the documents.
"""

import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import forest
from .common import append_columns, with_columns

SAMPLE_DOCUMENTS = 2_000
SAMPLE_FINDINGS = 4_000
MADE_FINDINGS = 3_000
TREES = 40
THRESHOLD = 0.5
MASK = "[SECRET]"
NEAR = 60
_KEYWORD = r"(?:password|passwd|pwd|secret|token|api_?key|access_?key)"
#: From the last keyword of a name to the value. A name goes on to the next keyword at most, so a long run is read once.
_SIGN = rf"(?i:{_KEYWORD}(?:(?!{_KEYWORD})[a-z0-9_.\-])*+[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)"
ASSIGNED = re.compile(_SIGN + r"([^\s\"'<>]{8,})")
RUN = re.compile(r"[A-Za-z0-9+/_=~.\-]{16,}")
_NAMED = re.compile(_SIGN + r"\Z")
_NAME = frozenset(string.ascii_letters + string.digits + "_.-")
#: Fixed words and formats that speak for or against a secret.
SECRET_WORDS = {"token", "key", "apikey", "api", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials",
                "private", "access"}
BENIGN_WORDS = {"commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "etag", "revision", "version",
                "integrity", "file", "path", "url", "http", "https", "mail", "email", "id", "isbn", "doi"}
PLACEHOLDERS = re.compile(r"(?i)example|sample|your|dummy|placeholder|changeme|xxxx|todo|foobar|test")
KNOWN = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk-|xox[abprs]-|AIza|eyJ[A-Za-z0-9_-]+\.eyJ|SG\.|npm_|hf_)")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9]*")
_TEST_PATH = re.compile(r"(?i)test|spec|fixture|example|mock|docs?/")
_HEX = re.compile(r"^[0-9a-fA-F]+$")
FEATURES = [
    "length", "digits", "upper", "lower", "other", "entropy", "switches", "transition", "coverage", "longest_word", "slashes",
    "dots", "extension", "test_path", "secret_word", "benign_word", "assigned", "quoted", "hex", "known", "distinct", "placeholder",
    "vowels",
]


class Language:
    """Words of a vocabulary file, and how likely its letters follow each other."""

    def __init__(self, path: str):
        import ahocorasick

        from .byte_bpe import read_ranks

        words = {t.decode("utf-8", "ignore").strip().lower() for t in read_ranks(path)}
        words = {w for w in words if len(w) >= 3 and w.isalpha()}
        self.words = ahocorasick.Automaton()
        for word in words or {"the"}:
            self.words.add_word(word, len(word))
        self.words.make_automaton()
        pairs = Counter(a + b for w in words for a, b in zip(w, w[1:]))
        firsts = Counter(c for w in words for c in w[:-1])
        self.pairs = {p: log2((n + 0.5) / (firsts[p[0]] + 13)) for p, n in pairs.items()}

    def coverage(self, text: str) -> tuple[float, int]:
        found = [n for _, n in self.words.iter_long(text)]
        return sum(found) / max(1, len(text)), max(found, default=0)

    def transition(self, text: str) -> float:
        return sum(self.pairs.get(a + b, -9.0) for a, b in zip(text, text[1:])) / max(1, len(text) - 1)


@lru_cache(maxsize=2)
def language(path: str) -> Language:
    return Language(path)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def describe(candidate: str, before: str, after: str, path: str, words: Language) -> list[float]:
    """The features of one finding, in the order of ``FEATURES``."""
    n = max(1, len(candidate))
    kinds = [_kind(c) for c in candidate]
    counts = Counter(candidate)
    lower = candidate.lower()
    covered, longest = words.coverage(lower)
    near = [w.lower() for w in _WORD.findall(before)[-4:]]
    head = before.rstrip("\"' ")
    return [
        n, kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        -sum(c / n * log2(c / n) for c in counts.values()), sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        words.transition(lower), covered, longest, candidate.count("/"), candidate.count("."),
        float(re.search(r"\.[a-z]{2,4}$", candidate) is not None), float(_TEST_PATH.search(path) is not None),
        float(any(w in SECRET_WORDS for w in near) or _NAMED.search(before) is not None), float(any(w in BENIGN_WORDS for w in near)),
        float(head[-1:] in ("=", ":")), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(_HEX.match(candidate) is not None), float(KNOWN.match(candidate) is not None), len(counts) / n,
        float(PLACEHOLDERS.search(candidate) is not None), sum(c in "aeiou" for c in lower) / n,
    ]


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of all candidates of a whole text, in characters: assigned values, and runs outside of them and their names."""
    spans, done = [], 0
    for m in ASSIGNED.finditer(text or ""):
        name = m.start()
        while name > done and text[name - 1] in _NAME:
            name -= 1
        spans += [r.span() for r in RUN.finditer(text, done, name)]
        spans.append(m.span(1))
        done = m.end()
    return spans + [r.span() for r in RUN.finditer(text or "", done)]


def around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]


def sure_label(candidate: str, before: str, after: str, words: Language) -> int | None:
    """1 or 0 where the words next to a finding and its form leave no doubt, else nothing."""
    near = {w.lower() for w in _WORD.findall(before)[-2:]}
    form = dict(zip(FEATURES, describe(candidate, before, after, "", words)))
    random_like = form["digits"] > 0.1 and form["coverage"] < 0.6 and form["distinct"] * form["length"] >= 8
    if (near & SECRET_WORDS or _NAMED.search(before)) and form["assigned"] and random_like and not form["placeholder"]:
        return 1
    if form["digits"] == 0 and form["switches"] < 0.2 or form["digits"] == 1 or form["extension"] or near & BENIGN_WORDS:
        return 0
    return None


def made_findings(n: int = MADE_FINDINGS, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings made by rule: random strings in public formats, and what is taken for them."""
    rng = random.Random(seed)
    draw = lambda alphabet, size: "".join(rng.choices(alphabet, k=size))
    letters, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    word = lambda k: "".join(rng.choices(syllables, k=k))
    prose = lambda: " ".join(word(rng.randint(1, 4)) for _ in range(6))
    rows = []
    for i in range(n):
        before, after, path = prose() + " ", " " + prose(), rng.choice(["src0", "app/config.py", "settings.yaml", "notes.md", ""])
        name = rng.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "TOKEN", "Secret key",
                           "SPRING_DATASOURCE_PASSWORD", "DATABASE_PASSWORD", "GITHUB_TOKEN", "dbPassword", "aws.secret.key", "API_KEY_" + word(3).upper(),
                           word(4).upper() + "_" + rng.choice(["PASSWORD", "TOKEN", "SECRET"])])
        sign, quote = rng.choice([" = ", "=", ": ", ":"]), rng.choice(['"', "'", ""])
        if i % 2:
            value = rng.choice([
                lambda: draw(hexes, rng.choice([32, 40, 64])), lambda: draw(hexes.upper(), 40), lambda: draw(letters, rng.randint(16, 48)),
                lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + draw(letters, 36),
                lambda: draw(letters + "!#$%*?@", rng.randint(8, 15)) + rng.choice("0123456789") + rng.choice("!#$%*?@"),
                lambda: word(3) + rng.choice("0123456789") + rng.choice("!#$%*?@") + draw(letters, rng.randint(1, 4)),
                lambda: "sk_live_" + draw(letters, 24), lambda: draw(letters + "+/", rng.randint(24, 44)) + "="])()
            bare = KNOWN.match(value) and rng.random() < 0.5
            rows.append((value, before if bare else before + name + sign + quote, after if bare else quote + after, path, 1))
        else:
            value, lead = rng.choice([
                lambda: (word(rng.randint(8, 14)), ""), lambda: (word(rng.randint(8, 14)).capitalize() + ".", ""),
                lambda: (word(10).upper(), ""), lambda: (draw(string.digits, rng.randint(16, 20)), ""),
                lambda: (draw(hexes, 40), rng.choice(["commit ", "sha1: ", "revision ", "checksum = "])),
                lambda: (draw(hexes, 64), rng.choice(["sha256:", "digest ", "integrity = "])),
                lambda: ("-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), rng.choice(["uuid ", "id = ", ""])),
                lambda: ("/".join(word(3) for _ in range(5)) + ".py", ""), lambda: (f"mail{i}.example.com", f"{i}@"),
                lambda: ("-".join(word(2) for _ in range(6)), ""), lambda: ("your_api_key_here_xxxx", "api_key = "),
                lambda: ("_".join(word(3) for _ in range(4)), ""), lambda: ("example-token-placeholder", 'token = "'),
                lambda: (word(rng.randint(4, 7)), name + sign), lambda: (draw(string.digits, rng.randint(8, 12)), "max_tokens" + sign),
                lambda: ("=" * rng.randint(16, 40), ""), lambda: ("-" * rng.randint(16, 40), "")])()
            rows.append((value, before + lead, after, path, 0))
    return rows


def corpus_findings(docs: DataFrame, path: Column, vocabulary: str, most_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """candidate, before, after, path, secret: sure findings of a hash sample of the documents."""
    share = 1.3 * most_documents / max(1, docs.count())
    draw = F.pmod(F.xxhash64("doc_id", F.lit("secret sample")), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.filter(draw < share).select(F.col("text").cast("string").alias("text"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = language(vocabulary)
        for batch in batches:
            found = []
            for text, where in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist()):
                for start, end in candidates(text):
                    finding = around(text, start, end)
                    label = sure_label(*finding, words)
                    if label is not None:
                        found.append((*finding, where, label))
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.int32())],
                names=["candidate", "before", "after", "path", "secret"])

    return rows.mapInArrow(run, "candidate string, before string, after string, path string, secret int")


def default_findings(docs: DataFrame, path: Column, vocabulary: str) -> list[tuple]:
    """A bounded list: findings made by rule, and sure findings of the corpus, as many of each label at most."""
    found = corpus_findings(docs, path, vocabulary)
    order = F.xxhash64("candidate", "before")
    rows = []
    for label in (0, 1):
        rows += found.filter(F.col("secret") == label).orderBy(order, "candidate", "before", "after", "path").limit(SAMPLE_FINDINGS // 2).collect()
    return made_findings() + [tuple(r) for r in rows]


def train(docs: DataFrame, findings: list[tuple], vocabulary: str, trees: int = TREES) -> list[np.ndarray]:
    """The forest of labelled findings (candidate, before, after, path, secret)."""
    words = language(vocabulary)
    x = np.array([describe(c, b, a, p or "", words) for c, b, a, p, _ in findings], dtype=np.float64)
    y = np.array([f[4] for f in findings], dtype=np.float64)
    return forest.train(docs.sparkSession, x, y, trees)


SPANS = "array<struct<start:bigint,n_chars:bigint,probability:double,is_secret:boolean>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n_chars", pa.int64()), ("probability", pa.float64()), ("is_secret", pa.bool_())]))


def annotate(
    docs: DataFrame, path: Column, trees: list[np.ndarray], vocabulary: str, name: str = "findings", mask: str | None = None
) -> DataFrame:
    """``docs`` with an array column of its findings; with ``mask`` the secrets in the text are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    where = f"{name}_path"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = language(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [candidates(text) for text in texts]
            x = [describe(*around(text, *span), p or "", words)
                 for text, own, p in zip(texts, spans, batch.column(where).to_pylist()) for span in own]
            chance = forest.probability(sent.value, np.array(x, dtype=np.float64)).tolist() if x else []
            found, at = [], 0
            for i, own in enumerate(spans):
                rows = [{"start": s, "n_chars": e - s, "probability": p, "is_secret": p >= THRESHOLD}
                        for (s, e), p in zip(own, chance[at : at + len(own)])]
                at += len(own)
                found.append(rows)
                if mask is not None and any(r["is_secret"] for r in rows):
                    parts, done = [], 0
                    for r in rows:
                        if r["is_secret"]:
                            parts += [texts[i][done : r["start"]], mask]
                            done = r["start"] + r["n_chars"]
                    texts[i] = "".join(parts) + texts[i][done:]
            if mask is not None:
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield with_columns(batch, **{name: pa.array(found, _SPANS)})

    df = docs.withColumns({"text": F.col("text").cast("string"), where: F.coalesce(path.cast("string"), F.lit(""))})
    return append_columns(df, f"`{name}` {SPANS}", run).drop(where)


def findings(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per candidate: doc_id, start, n_chars, probability, is_secret."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    path = F.col("source")
    trees = train(rows, default_findings(rows, path, vocabulary), vocabulary)
    found = annotate(rows, path, trees, vocabulary).select("doc_id", F.explode("findings").alias("f"))
    return found.select("doc_id", "f.start", "f.n_chars", "f.probability", "f.is_secret")


def redact(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The documents with each secret replaced by ``MASK``; n_chars, where there, follows the text."""
    path, name = F.col("source"), "_secret_findings"
    trees = train(docs, default_findings(docs, path, vocabulary), vocabulary)
    masked = annotate(docs, path, trees, vocabulary, name, MASK)
    if "n_chars" in docs.columns:
        changed = F.exists(name, lambda f: f["is_secret"])
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)
