"""Language identification as a mixture: each document's language shares by expectation-maximisation over the
likelihoods of its character n-grams, and the set of languages by penalised likelihood."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: N-grams of one to MAX_N characters are hashed to so many cells.
CELLS = 1 << 16
MAX_N = 3
#: About so many labelled documents of each language are learned from, chosen by the hash of doc_id.
SAMPLE = 3000
#: Characters whose n-grams are counted at a time.
PIECE = 1 << 20
#: Characters that may be letters; numerals such as fractions are among them.
LETTER = re.compile(r"[^\W\d_]")
GAPS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: A text whose main language has less than this share of its n-grams is rejected by with_language: it is in no one language.
MAIN_SHARE = 0.5
COUNTS = "lang string, cell int, n long"


def has_letter(text: str) -> bool:
    return any(x.group().isalpha() for x in LETTER.finditer(text))


def cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of a text (words in lower case with a blank at each end), and how often each occurs."""
    found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    flat = f" {GAPS.sub(' ', text.lower()).strip()} "
    for at in range(0, max(len(flat) - 2, 1), PIECE):
        x = np.frombuffer(flat[at : at + PIECE + 2].encode("utf-32-le"), "<u4").astype(np.uint64)
        y = x * np.uint64(0x9E3779B97F4A7C15)
        grams = [y[x != 32]]
        for _ in range(MAX_N - 1):
            y = (y[:-1] ^ (y[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[len(x) - len(y) + 1 :] * np.uint64(0x94D049BB133111EB)
            grams.append(y)
        c, n = np.unique((np.concatenate(grams) >> np.uint64(64 - 16)).astype(np.int64), return_counts=True)
        if at:
            both, back = np.unique(np.concatenate([found, c]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
            found = both
        else:
            found, counts = c, n
    return found, counts


@dataclass(frozen=True)
class Model:
    """p: the probability of each cell in each language, a row per cell."""

    langs: tuple[str, ...]
    p: np.ndarray

    def mixture(self, p: np.ndarray, n: np.ndarray, share: np.ndarray, least: float, rounds: int = 60) -> tuple[np.ndarray, float]:
        """Shares of the languages, columns of p, that make the document most likely, from these shares on, and
        its log likelihood then. Ends when a round adds less than `least` to it."""
        before = -np.inf
        for _ in range(rounds):
            joint = p * share
            mass = joint.sum(axis=1)
            now = float(n @ np.log(mass))
            if now - before < least:
                break
            before = now
            share = (n / mass) @ joint / n.sum()
        return share, now

    def predict(self, text: str | None, penalty: float = 1.0) -> tuple[str, float, list[str], list[float]]:
        """The main language, its share, and the set with all shares, largest first. The set begins with the
        likeliest language; then, of all that aren't in it, that comes in which adds most likelihood, as long as one adds more than
        penalty * MAX_N * log(n-grams) / 2: n-grams of one place overlap, so each tells less than an independent one
        would. Likelihood is concave in the shares, so its slope towards a language bounds what it can add, and
        those that can't pay aren't tried. Null and letterless: UNKNOWN, 0."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, [], []
        c, n = cells(text)
        total = int(n.sum())
        cost = penalty * MAX_N * np.log(max(total, 2)) / 2
        p = self.p[c]
        alone = n @ np.log(p)
        among = [int(np.argmax(alone))]
        share, best = np.ones(1), float(alone[among[0]])
        while len(among) < len(self.langs):
            slope = (n / (p[:, among] @ share)) @ p - total
            tried = []
            for k in np.flatnonzero(slope > cost):
                if k not in among:
                    first = np.append(share * 0.9, 0.1)
                    found, now = self.mixture(p[:, [*among, k]], n, first, cost / 100)
                    tried.append((now, -int(k), found))
            if not tried or (top := max(tried, key=lambda x: x[:2]))[0] - best <= cost:
                break
            best, k, share = top[0], -top[1], top[2]
            among = [*among, k]
        order = np.argsort(-share, kind="stable")
        return self.langs[among[order[0]]], float(min(1.0, share[order[0]])), [self.langs[among[i]] for i in order], [float(share[i]) for i in order]


def held_out(doc_id):
    """Whether a document is kept from learning; a null doc_id is as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the documents (doc_id, text, lang) that aren't held out and have a text and a language. Of
    a language with more than sample documents, those with the smallest hashes of doc_id are taken, about
    sample of them: the share that makes it so is known from a count over all. N-grams are counted where the
    documents are; the driver gets CELLS rows a language at most. Smoothed by half a count."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = usable.groupBy("lang").count().collect()
    if not sizes:
        return Model((), np.zeros((CELLS, 0)))
    most = F.lit(None).cast("double")
    for x in sizes:
        most = F.when(F.col("lang") == x.lang, F.lit(min(1.0, sample / x["count"]))).otherwise(most)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                c, n = cells(text.as_py())
                if lang not in sums:
                    sums[lang] = np.zeros(CELLS, np.int64)
                sums[lang][c] += n
        for lang, s in sums.items():
            c = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int32)), pa.array(s[c])], names=["lang", "cell", "n"])

    rows = usable.where(part < most).select("text", "lang").mapInArrow(count, COUNTS).groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(x.lang for x in sizes))
    p = np.full((CELLS, len(langs)), 0.5)
    for k, lang in enumerate(langs):
        own = rows[rows.lang == lang]
        p[own.cell.to_numpy(), k] += own.n.to_numpy()
    return Model(langs, p / p.sum(axis=0))


def predictor(docs: DataFrame, model: Model):
    """A pandas UDF: struct<lang_pred, score, langs, shares> of a text."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,langs:array<string>,shares:array<double>>")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(x) for x in text], columns=["lang_pred", "score", "langs", "shares"])

    return predict


def language_mixture(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """For each row of docs (doc_id, text, and lang to learn from, if no model is given): the main language of
    the whole text, its share, and all languages found with their shares. Repeated rows count as often as they
    occur. Null texts and texts without a letter are `und` with score 0, as are all if nothing was learned."""
    predict = predictor(docs, model := model or learn(docs))
    (found,) = fresh(docs, "found")
    x = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias(found))
    return x.select("doc_id", "held_out", *(F.col(f"{found}.{c}").alias(c) for c in ("lang_pred", "score", "langs", "shares")))


def with_language(docs: DataFrame, model: Model | None = None, main_share: float = MAIN_SHARE) -> DataFrame:
    """The rows of docs whose text has a language, with all their columns: null texts, texts without a letter and texts
    whose main language has a share below main_share go, as do all if nothing was learned. Repeated rows, and rows with a null doc_id, are judged like others."""
    predict = predictor(docs, model := model or learn(docs))
    (found,) = fresh(docs, "found")
    kept = (F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= main_share)
    return docs.withColumn(found, predict(F.col("text"))).where(kept).select(*docs.columns)
