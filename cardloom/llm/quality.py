"""Quality classifier from weak labels.

Overlapping heuristics vote good (1), junk (0) or abstain (-1) on each text.
Their votes over the whole corpus, counted by pattern, go to an expectation
maximisation that estimates each heuristic's votes on good and on junk texts
(its accuracy) and the share of junk, without any given label. The posterior
of a text's pattern is its soft label, and a logistic regression on hashed
features of the text's word shapes and statistics is fitted to the soft
labels of a bounded sample. That scorer judges every text.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import fresh, give_back, materialize, small_batches, smallest_by_hash

STATISTICS = ("symbols", "capitals", "repeats", "repeated_lines", "bars", "word_length", "digits")
FEATURES = 1 << 16


#: Kinds of code points in the category table.
LETTER, CAPITAL, DIGIT, SPACE, SYMBOL, BAR, OTHER = range(7)


@lru_cache(maxsize=1)
def categories() -> np.ndarray:
    """The kind of each code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(0x30000):  # higher planes hold no letters with cases, digits or spaces that matter here
        kind = unicodedata.category(chr(code))
        if kind[0] in "LM":
            table[code] = CAPITAL if kind == "Lu" else LETTER
        elif kind[0] == "N":
            table[code] = DIGIT
        elif chr(code).isspace():
            table[code] = SPACE
    table[[ord(c) for c in "#$%&*!@^~=<>+\\"]] = SYMBOL
    table[[ord(c) for c in "|•»"]] = BAR
    return table


def profile(text: str, with_tokens: bool) -> tuple | None:
    """n_words, the statistics, and the distinct word shapes of a text; None without words.

    A shape has X for capitals, x for other letters, 9 for digits, each run
    of a kind or of one sign once; the first 12 signs count.
    """
    words = text.split()
    if not words:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = categories()[codes]
    n, chars, count = len(words), len(codes), np.bincount(kinds, minlength=7)
    lines = [x for x in text.split("\n") if x]
    numbers = (
        n, (count[SYMBOL] + count[BAR]) / chars, count[CAPITAL] / chars, 1 - len(set(words)) / n,
        1 - len(set(lines)) / max(len(lines), 1), count[BAR] / n, chars / n, count[DIGIT] / chars,
    )
    tokens = []
    if with_tokens:
        signs = np.where(kinds == LETTER, ord("x"), np.where(kinds == CAPITAL, ord("X"), np.where(kinds == DIGIT, ord("9"), np.where(kinds == SPACE, 32, codes)))).astype(np.uint32)
        first = np.ones(chars, bool)
        first[1:] = signs[1:] != signs[:-1]
        tokens = sorted({w[:12] for w in signs[first].tobytes().decode("utf-32-le").split(" ")} - {""})
    return (*map(float, numbers), tokens)


STATS_TYPE = "struct<n_words:double," + ",".join(f"{s}:double" for s in STATISTICS) + ",shapes:array<string>>"


def _profiles(with_tokens: bool):
    def run(texts: pd.Series) -> pd.DataFrame:
        empty = (None,) * (len(STATISTICS) + 2)
        rows = [profile(t or "", with_tokens) or empty for t in texts]
        return pd.DataFrame(rows, columns=["n_words", *STATISTICS, "shapes"])

    return F.pandas_udf(run, STATS_TYPE)


def statistics(text: Column, with_tokens: bool = False) -> Column:
    """A struct of n_words, :data:`STATISTICS` and shapes; its fields are null for texts without words."""
    return _profiles(with_tokens)(F.coalesce(text, F.lit("")))


def votes(s: Column) -> list[Column]:
    """One vote a heuristic; a text may get several, and they may differ."""

    def vote(junk: Column, good: Column) -> Column:
        return F.when(s["n_words"].isNull(), -1).when(junk, 0).when(good, 1).otherwise(-1).cast("int")

    enough = s["n_words"] >= 20
    return [
        vote(s["symbols"] > 0.03, s["symbols"] < 0.005),
        vote((s["capitals"] > 0.25) & (s["n_words"] > 5), s["capitals"] < 0.08),
        vote(enough & (s["repeats"] > 0.7), enough & (s["repeats"] < 0.5)),
        vote(s["repeated_lines"] > 0.4, enough & (s["repeated_lines"] == 0)),
        vote(s["bars"] > 0.15, s["bars"] == 0),
        vote(enough & ((s["word_length"] > 9) | (s["word_length"] < 3)), enough & s["word_length"].between(4, 8)),
        vote(s["digits"] > 0.4, s["digits"] < 0.02),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Latent classes: good texts (0), and for each heuristic j the kind of junk it is after (j + 1).

    Heuristics are taken to err independently within a class, which they
    don't within junk as a whole: its kinds exclude each other. prior[c]:
    share of class c; table[c, j, v]: chance that heuristic j, if it votes on
    class c, votes v. An abstention says nothing: most come of a text's
    length, for several heuristics at once.
    """

    prior: np.ndarray
    table: np.ndarray

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        voted, votes = patterns >= 0, np.maximum(patterns, 0)
        each = np.log(self.table)[:, np.arange(patterns.shape[1]), votes]  # class, pattern, heuristic
        logs = (each * voted).sum(axis=2) + np.log(self.prior)[:, None]
        p = np.exp(logs - logs.max(axis=0))
        return p / p.sum(axis=0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a text with the votes is good."""
        return self.classes(patterns)[0]

    def accuracies(self) -> np.ndarray:
        """By heuristic: the chance that its vote is right, over all classes."""
        right = np.concatenate([self.table[:1, :, 1], self.table[1:, :, 0]])
        return (self.prior[:, None] * right).sum(axis=0)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> LabelModel:
    """Estimate the label model from vote patterns and how many texts show each."""
    junk = (patterns == 0).T.astype(float)
    p = np.concatenate([(junk.sum(axis=0) == 0)[None].astype(float), junk / np.maximum(junk.sum(axis=0), 1)])
    p = 0.9 * p + 0.1 / len(p)
    for _ in range(steps):
        w = p * counts
        prior = (w.sum(axis=1) + 1) / (w.sum() + len(w))
        table = np.stack([w @ (patterns == v) + 0.5 for v in (0, 1)], axis=2)
        model = LabelModel(prior, table / table.sum(axis=2, keepdims=True))
        p = model.classes(patterns)
    return model


def tokens(s: Column) -> Column:
    """The word shapes and the binned statistics of a profile."""
    bins = [F.concat(F.lit(f"\0{name}="), F.floor(F.coalesce(s[name], F.lit(0.0)) * (1 if name == "word_length" else 10)).cast("string")) for name in STATISTICS]
    return F.concat(F.coalesce(s["shapes"], F.array().cast("array<string>")), F.array(*bins))


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    scorer: LogisticRegressionModel | None  # None: no text had words


def _hashed(df: DataFrame, text_col: str) -> DataFrame:
    stats = df.withColumn("quality_stats", statistics(F.col(text_col), True))
    told = stats.withColumn("quality_tokens", tokens(F.col("quality_stats")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="quality_tokens", outputCol="quality_features").transform(told)


def fit(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_rows: int = 12_000) -> QualityModel:
    """Estimate the heuristics' accuracies on all rows; fit the scorer on at most ``max_rows`` of them.

    The sample holds the rows of the smallest hashes of id and text, whatever
    their order. Texts without words take no part; repeated rows count once
    in the sample, each time in the accuracies.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(statistics(F.col(text_col)).alias("s"))
    names = [f"v{j}" for j in range(len(votes(F.col("s"))))]
    voted = rows.select(F.col("s.n_words").isNotNull().alias("told"), *(v.alias(n) for v, n in zip(votes(F.col("s")), names)))
    counted = voted.filter("told").groupBy(*names).agg(F.count("*").alias("n")).toPandas()  # at most 3 ** heuristics rows
    if counted.empty:
        return QualityModel(LabelModel(np.full(len(names) + 1, 1 / (len(names) + 1)), np.full((len(names) + 1, len(names), 2), 1 / 2)), None)
    patterns, counts = counted[names].to_numpy(), counted["n"].to_numpy()
    labels = expectation_maximisation(patterns, counts)
    soft = spark.createDataFrame([(*map(int, x), float(p)) for x, p in zip(patterns, labels.posterior(patterns))], ", ".join(f"{n} int" for n in names) + ", p double")
    worded = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(r"\S"))
    hashed = _hashed(smallest_by_hash(worded, max_rows).select("text"), "text").filter("quality_stats.n_words is not null")
    hashed = hashed.select("quality_features", *(v.alias(n) for v, n in zip(votes(F.col("quality_stats")), names)))
    weighted = hashed.join(F.broadcast(soft), names).select("quality_features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")),
    )).alias("x")).select("quality_features", "x.*").filter("weight > 1e-6")
    weighted = materialize(weighted, "quality-sample")
    regression = LogisticRegression(featuresCol="quality_features", labelCol="label", weightCol="weight", regParam=1e-5, maxIter=50, standardization=False)
    model = QualityModel(labels, regression.fit(weighted))
    give_back()
    return model


def score(df: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with quality (0 to 1) and keep (1 if quality >= threshold); columns of these names give way.

    Texts without words (null, empty, blank) have quality 0.
    """
    small_batches(df.sparkSession)
    df = df.drop("quality", "keep")
    if model.scorer is None:
        return df.withColumns({"quality": F.lit(0.0), "keep": F.lit(0)})
    row = fresh(df, "row")
    packed = df.select(F.struct(*df.columns).alias(row), F.col(text_col).alias("quality_text"))
    judged = model.scorer.setProbabilityCol("quality_p").setPredictionCol("quality_y").setRawPredictionCol("quality_r").transform(_hashed(packed, "quality_text"))
    p = F.when(F.col("quality_stats.n_words").isNull(), 0.0).otherwise(vector_to_array("quality_p")[1])
    return judged.select(f"{row}.*", p.alias("quality")).withColumn("keep", (F.col("quality") >= threshold).cast("int"))
