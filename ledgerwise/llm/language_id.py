"""Language identification in two steps: the family first, then one language against another within it.

Texts become vectors of hashed byte trigrams over the whole text. A linear support vector machine
per family separates it from the others; within the chosen family every pair of languages has one
of its own, and the language with most wins (then the largest summed margin) is taken. Each machine
is trained in a task of its own by dual coordinate descent, on a bounded sample of labelled rows:
at most ``ROWS_PER_LANGUAGE`` of each language and at least one, drawn by a hash of id and text. Every row is predicted.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null label do
not teach; languages outside ``FAMILIES`` are a family each; with one learned language, or none,
there is nothing to separate and all texts with letters get it, or ``und``; repeated rows and null ids
are rows like others; an empty table gives an empty table; other columns are not read.
"""

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, id_and_text, remainder, written

ROWS_PER_LANGUAGE = 500
DIMENSIONS = 1 << 13
EPOCHS = 12
COST = 1.0
#: Fixed: families of languages by code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "mr", "ne", "bn", "pa", "gu", "ur"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower(), f"={lang}")


def features(text: str) -> np.ndarray:
    """Unit vector of damped counts of hashed byte trigrams; one constant entry stands for the bias."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES) + b" ", dtype=np.uint8).astype(np.uint32)
    hashed = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 13)
    counts = np.sqrt(np.bincount(hashed, minlength=DIMENSIONS).astype(np.float32))
    norm = np.sqrt(counts @ counts)
    return np.append(counts / norm if norm else counts, np.float32(1.0))


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter. The pattern also takes number signs, but no letter is missing from it."""
    first = _LETTER.search(text) if text else None
    return first is not None and (first.group().isalpha() or any(map(str.isalpha, text)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss) by dual coordinate descent.

    Classes weigh the same however many rows they have."""
    order = np.random.default_rng(7)
    weights = np.zeros(x.shape[1], dtype=np.float64)
    alpha = np.zeros(len(x))
    square = np.einsum("ij,ij->i", x, x)
    positive = max(1, int((y > 0).sum()))
    most = np.where(y > 0, cost * len(x) / (2 * positive), cost * len(x) / (2 * max(1, len(x) - positive)))
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ weights) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights.astype(np.float32)


def _vector_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t or "").astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("place"), pa.array(vectors, pa.binary())], names=["lang", "place", "vector"])

    return rows.select("lang", "place", "text").mapInArrow(run, "lang string, place int, vector binary")


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """The machines: {"langs": ..., "families": ..., "models": {(positive, negative): weights}}.

    ``labelled`` has doc_id, text and lang. The model's size depends on the number of languages only.
    """
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select("lang", "text", draw.alias("draw"))
    counts = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()}
    langs = sorted(counts)
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    jobs = []
    if len(families) > 1:
        jobs += [(family, "", own, [x for x in langs if x not in own]) for family, own in sorted(families.items())]
    for family, own in sorted(families.items()):
        jobs += [(a, b, [a], [b]) for a, b in combinations(own, 2)]
    models = {}
    if jobs:
        # A share per language that leaves the bound on average, and the first draw whatever it is; then the bound itself by
        # rank, which Spark applies in each task before it deals out what is left.
        share: Column = F.lit(0.0)
        for lang, (n, least) in counts.items():
            share = F.when(F.col("lang") == lang, F.lit(max(least, 1.2 * rows_per_language / n))).otherwise(share)
        place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
        drawn = rows.filter(F.col("draw") <= share).withColumn("place", place).filter(F.col("place") <= rows_per_language)
        sample = written(_vector_rows(drawn), "language-sample")
        # A side of many languages takes fewer of each, so a machine's rows stay bounded, but one at least.
        sides = [(i, lang, sign, max(1, int(rows_per_language * min(1.0, 2.0 / len(names))))) for i, j in enumerate(jobs)
                 for sign, names in ((1, j[2]), (-1, j[3])) for lang in names]
        pairs = sample.sparkSession.createDataFrame(sides, "job int, lang string, sign int, most int")

        def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["lang", "place"])
            x = np.frombuffer(b"".join(rows["vector"]), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)
            weights = train(x, rows["sign"].to_numpy().astype(np.float64))
            return pd.DataFrame({"job": [key[0]], "weights": [weights.tobytes()]})

        learned = sample.join(pairs, "lang").filter("place <= most").groupBy("job").applyInPandas(learn, "job int, weights binary")
        for row in learned.collect():
            models[jobs[row["job"]][:2]] = np.frombuffer(row["weights"], dtype=np.float32)
    return {"langs": langs, "families": families, "models": models}


def predict_vectors(x: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each row."""
    names, families, models = sorted(model["families"]), model["families"], model["models"]
    size = len(x)
    squash = lambda m: 1 / (1 + np.exp(-4 * m))
    if len(names) > 1:
        margins = np.stack([x @ models[(f, "")] for f in names], axis=1)
        chosen, score = margins.argmax(axis=1), squash(margins.max(axis=1))
    else:
        chosen, score = np.zeros(size, dtype=np.int64), np.ones(size)
    result = np.empty(size, dtype=object)
    for f, name in enumerate(names):
        rows, own = np.flatnonzero(chosen == f), families[name]
        wins, total = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
        for a, b in combinations(range(len(own)), 2):
            margin = x[rows] @ models[(own[a], own[b])]
            wins[:, a] += margin > 0
            wins[:, b] += margin <= 0
            total[:, a] += margin
            total[:, b] -= margin
        # Wins are whole numbers; the squashed sum only orders equal ones.
        best = (wins + squash(total) * 0.5).argmax(axis=1) if len(rows) else np.zeros(0, dtype=np.int64)
        result[rows] = [own[i] for i in best]
        if len(own) > 1 and len(rows):
            score[rows] *= squash(total[np.arange(len(rows)), best] / (len(own) - 1))
    return result.tolist(), score


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of ``docs``: doc_id, predicted language, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    step = 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                texts = part.column("text").to_pylist()
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if has_letter(t)] if learned["langs"] else []
                if rows:
                    found, score = predict_vectors(np.stack([features(texts[i]) for i in rows]), learned)
                    for i, lang, s in zip(rows, found, score.tolist()):
                        langs[i], scores[i] = lang, s
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all of them."""
    rest = F.coalesce(remainder(F.col("doc_id"), folds), F.lit(-1))
    model = fit(docs.filter(rest != held), rows_per_language)
    found = predict(docs, model)
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
