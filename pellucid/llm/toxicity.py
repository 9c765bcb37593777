"""Toxicity by weak supervision.

Many weak voters look at a text: word lists, patterns, and terms (words and word beginnings) induced from
labelled rows. A generative label model, fitted by expectation maximisation, estimates how often each
voter fires on toxic and on other texts - the rows' labels being just one more voter, which may err - and
how far voters are correlated given the class; correlated voters share their say. A linear classifier
over terms is then trained on the posterior labels, and it alone scores texts.

What is fitted sees a bounded sample of labelled rows (``SAMPLE_ROWS``, those of the least hashes of
their ids, never held-out ones); every text of the table is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import materialize

SAMPLE_ROWS = 12_000
#: Terms counted in a task before they are handed on.
HELD_TERMS = 1 << 17
FOLDS = 5
PREFIXES = (4, 5, 6, 7, 8)
INDUCED_VOTERS, CLASSIFIER_TERMS, MIN_ROWS = 96, 400, 3
#: Voters correlated more than this, given the class, share one say between them.
CORRELATED = 0.5
RIDGE, STEPS, RATE = 1.0, 250, 0.05
#: A toxic row counts as so many others.
EMPHASIS = 3.0

# Words of abuse by kind and language. Each list is one voter.
WORD_LISTS = {
    "insult": "idiot moron stupid loser clown fool imbecile dumb jerk dimwit cretin",
    "contempt": "pathetic worthless disgusting scum trash filth vermin garbage scumbag",
    "hatred": "hate despise kill die hang burn destroy subhuman",
    "de": "idiot dumm dummkopf abschaum wertlos ekelhaft trottel verlierer müll",
    "fr": "idiot stupide imbécile crétin ordure déchet pathétique minable dégoûtant",
    "es": "idiota estúpido imbécil basura escoria patético asqueroso inútil perdedor",
}
PATTERNS = {
    "address": r"\b[Yy]ou(?:'re| are)? (?:an? |such |all |just )*(?:\w+ )?(?:idiot|fool|loser|joke|disgrace)s?\b",
    "shouting": r"\b[A-Z]{3,}(?: [A-Z]{2,}){2,}\b",
    "marks": r"!{3,}|\?!\?",
    "masked": r"\b[A-Za-z]\*{2,}[A-Za-z]*",
}
_LISTS = {k: frozenset(v.split()) for k, v in WORD_LISTS.items()}
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}
_WORD = re.compile(r"[^\W\d_]+")


def text_terms(text: str) -> set[str]:
    """Distinct words of letters, and the beginnings of longer ones, marked with a hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in PREFIXES))


def fixed_votes(text: str, terms: set[str]) -> list[bool]:
    return [bool(terms & words) for words in _LISTS.values()] + [bool(p.search(text)) for p in _PATTERNS.values()]


@dataclass
class Classifier:
    bias: float = -3.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        margin = self.bias + sum(self.weights[t] for t in self.weights.keys() & text_terms(text))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior probabilities of the class for rows of binary votes, and what the model has estimated.

    votes: rows x voters; labels: 0 or 1 per row, a voter with errors of its own.
    """
    fires = np.column_stack([votes, labels.astype(bool)]).astype(float)
    posterior = np.where(labels == 1, 0.9, 0.02)
    share = np.ones(fires.shape[1])
    for k in range(rounds):
        prior = (posterior.sum() + 1) / (len(posterior) + 2)
        on = [(p @ fires + 0.5) / (p.sum() + 1) for p in (1 - posterior, posterior)]
        if k == rounds // 2:  # correlations given the class, once accuracies have settled
            rest = fires - np.outer(1 - posterior, on[0]) - np.outer(posterior, on[1])
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            correlation = (rest.T @ rest) / len(rest) / np.outer(spread, spread)
            share = 1 / np.where(np.abs(correlation) > CORRELATED, np.abs(correlation), 0).sum(0).clip(1)
        says = np.log(on[1] / on[0]), np.log((1 - on[1]) / (1 - on[0]))
        margin = np.log(prior / (1 - prior)) + fires @ (share * says[0]) + (1 - fires) @ (share * says[1])
        posterior = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    return posterior, {"prior": prior, "fires_on_others": on[0], "fires_on_toxic": on[1], "share": share}


def _ridge(columns: list[np.ndarray], n_terms: int, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression on soft targets: full-batch steps of Adam (Kingma and Ba, 2015), and a ridge.

    The last weight is the bias, which has no ridge.
    """
    lengths = np.array([len(c) + 1 for c in columns])
    index = np.concatenate([np.append(c, n_terms) for c in columns]).astype(np.int64)
    row = np.repeat(np.arange(len(columns)), lengths)
    w, first, second = np.zeros(n_terms + 1), np.zeros(n_terms + 1), np.zeros(n_terms + 1)
    w[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    emphasis = 1 + (EMPHASIS - 1) * target
    ridge = np.append(np.full(n_terms, RIDGE), 0.0)
    for k in range(1, STEPS + 1):
        margin = np.bincount(row, weights=w[index], minlength=len(columns))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) * emphasis
        slope = np.bincount(index, weights=error[row], minlength=n_terms + 1) + ridge * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        rate = RATE * min(1.0, 2 * (1 - k / (STEPS + 1)))
        w -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return float(w[-1]), w[:-1]


def _count_terms(batches):
    counts: dict[str, list[int]] = {}

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=["term", "c0", "c1"])
        counts.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            for t in text_terms(text.as_py()):
                counts.setdefault(t, [0, 0])[label] += 1
            if len(counts) > HELD_TERMS:
                yield rows()
    yield rows()


def _look(induced: list[str], chosen: list[str]):
    """Each sampled row's label, its votes, and which of the chosen terms it has."""
    place = {t: k for k, t in enumerate(chosen)}

    def run(batches):
        for batch in batches:
            votes, terms = [], []
            for text in batch.column("text"):
                text = text.as_py()
                own = text_terms(text)
                votes.append(fixed_votes(text, own) + [t in own for t in induced])
                terms.append(sorted(place[t] for t in own & place.keys()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(votes, pa.list_(pa.bool_())), pa.array(terms, pa.list_(pa.int32()))], names=["id", "toxic", "votes", "terms"])

    return run


def fit(sample: DataFrame) -> Classifier:
    """Voters, label model and classifier from a bounded table of (id, toxic, text).

    Terms are counted where the texts are; the driver gets the best of them, by the strength and support of
    their association with the labels, and for each sampled row its votes and places of chosen terms.
    """
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n:
        return Classifier()
    counts = sample.select("text", "toxic").mapInArrow(_count_terms, "term string, c0 long, c1 long").groupBy("term").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    odds = F.log((F.col("c1") + 0.5) / (max(1, n.get(1, 0)) + 1)) - F.log((F.col("c0") + 0.5) / (max(1, n.get(0, 0)) + 1))
    told = materialize(counts.where(F.col("c0") + F.col("c1") >= MIN_ROWS).select("term", odds.alias("odds"), (odds * F.sqrt(F.col("c0") + F.col("c1"))).alias("z")))
    induced = [r["term"] for r in told.where("z > 0 AND odds > 1.5").orderBy(F.desc("z"), "term").limit(INDUCED_VOTERS).collect()]
    chosen = [r["term"] for r in told.orderBy(F.desc(F.abs("z")), "term").limit(CLASSIFIER_TERMS).collect()]
    rows = sorted(sample.mapInArrow(_look(induced, chosen), "id long, toxic int, votes array<boolean>, terms array<int>").collect(), key=lambda r: r["id"])
    posterior, _ = label_model(np.array([r["votes"] for r in rows]), np.array([r["toxic"] for r in rows]))
    bias, weights = _ridge([np.array(r["terms"], dtype=np.int64) for r in rows], len(chosen), posterior)
    return Classifier(bias, {t: float(w) for t, w in zip(chosen, weights, strict=True) if abs(w) > 1e-4})


def fold(id_col) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).where(fold("id") != 0)
    taken = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample is bounded, so the texts of the table stay where they are
    rows = texts.join(F.broadcast(materialize(taken)), "id").dropDuplicates(["id"])
    return fit(materialize(rows.select("id", "toxic", "text")))


def _score(model):
    def run(batches):
        known = model.value
        for batch in batches:
            scores = [known.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "held_out")), pa.array(scores, pa.float64())], names=["id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    Null texts count as empty; they, like texts without any known term, get the bias alone. A null id is
    held out if crc32 of the empty text says so. Ids that have several labels count as toxic if one says
    so; without any labels all scores are low. Repeated rows are kept, other columns are ignored, an empty
    table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_score(model), "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted to be toxic; all columns are kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    def run(batches):
        known = model.value
        for batch in batches:
            keep = [known.score(t.as_py() or "") < 0.5 for t in batch.column(text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # whole rows pass through the workers, so they are written in small batches
    return materialize(docs.mapInArrow(run, docs.schema))
