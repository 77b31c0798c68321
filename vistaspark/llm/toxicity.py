"""Toxicity by weak supervision.

Voters fire or abstain. Lexicon voters (words that start with a stem: once, or as two different words and often
enough for the text's length) are induced from a bounded sample of labelled rows; pattern voters
look at shouting, exclamation marks and masked letters; a text without any stem is a vote for
clean. A generative label model (a latent label,
voters that fire with class-wise rates) is fitted by expectation maximisation over the vote
patterns of all training documents, labelled ones held at their label; correlations between voters
within a class are estimated from the same sums and divide the weight of voters that repeat each
other. A linear classifier (logistic, by Newton steps) is then trained on the posterior labels; its
features are the votes and counts of stem hits.

The passes over patterns are distributed: documents are reduced to (pattern, count) rows and every
step adds up vectors of a fixed length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import free_names, materialise, releasing, table, text_or_empty
from ._text import slices

TRAIN_ROWS = 12_000  # labelled rows that the stems are induced from (lowest hash of doc_id)
MOST_VOTERS = 64  # stems, those of the greatest gain; each votes in two ways (the label model holds the square)
WORD_BITS = 63  # votes in one long of a pattern
COVER = 4  # stems wanted for each toxic document of the sample
STEM_LENGTHS = range(3, 9)
WORDS_PER_HIT = 250  # a repeated stem counts when at least one word in so many has it
HELD_STEMS, KNOWN_WORDS = 100_000, 100_000  # kept by a task: stems before it sends its counts, words looked up
ROUNDS = 12
SAME = 0.6  # voters that correlate more than this within a class share their weight
THRESHOLD = 0.7

_letters = re.compile(r"[^\W\d_]+")
_shout = re.compile(r"\b[A-Z]{3,}\b")
_masked = re.compile(r"[^\W\d_][*#$@%]{2,}[^\W\d_]")
PATTERNS = ("shouting", "exclaiming", "masked letters", "no stem")  # the last one votes for clean
COUNTS = (1, 2, 3, 5, 8)  # different hit words: extra features of the classifier
DENSITIES = (400, 200, 100, 50)  # one hit word in so many words


@dataclass(frozen=True, order=True, slots=True)
class Stem:
    text: str
    repeated: bool  # needs two different words, often enough


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from: crc32(doc_id as text) mod 3 is not 1 (null: not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def words_of(text: str) -> list[str]:
    return _letters.findall(text.lower())


def stems_of(text: str) -> set[Stem]:
    """Every (stem, repeated) that fires in a text."""
    words = words_of(text)
    times, forms = Counter(), Counter()
    for w, n in Counter(words).items():
        for size in STEM_LENGTHS:
            if len(w) < size:
                break
            times[w[:size]] += n
            forms[w[:size]] += 1
    return {Stem(s, False) for s in times} | {
        Stem(s, True) for s, n in forms.items() if n > 1 and times[s] * WORDS_PER_HIT >= len(words)}


# --- induction -------------------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled training documents (a proven bound, so
    the labels are broadcast). Of repeated labels for one doc_id the highest counts."""
    picked = (labels.where(in_training()).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")


def induce_stems(sample: DataFrame, most: int = MOST_VOTERS) -> list[Stem]:
    """Greedy cover of the sample's toxic documents, COVER times each, by stems that are rare in its
    clean ones; of equal stems the longest."""
    sample = materialise(sample.where("toxic in (0, 1)"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            every = sorted(toxic.keys() | clean.keys())
            return pa.record_batch({"stem": pa.array([s.text for s in every], pa.string()),
                                    "repeated": pa.array([s.repeated for s in every], pa.bool_()),
                                    "toxic": pa.array([toxic[s] for s in every], pa.int64()),
                                    "clean": pa.array([clean[s] for s in every], pa.int64())})

        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                (toxic if label else clean).update(stems_of(text))
                if len(toxic) + len(clean) > HELD_STEMS:  # sums of parts are added up after the shuffle
                    yield counted()
                    toxic.clear()
                    clean.clear()
        yield counted()

    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return []
    least = max(3, round(0.004 * size[1]))
    counts = (sample.select("doc_id", "text", "toxic").mapInArrow(releasing(count), "stem string, repeated boolean, toxic long, clean long")
              .groupBy("stem", "repeated").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
              .where(f"t >= {least} and t >= 2 * c"))
    chosen = frozenset(Stem(r["stem"], r["repeated"]) for r in counts.collect())  # of the bounded sample

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {s: i for i, s in enumerate(sorted(chosen))}
        for batch in batches:
            hits = [sorted(index[s] for s in stems_of(t) & chosen) for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"toxic": batch.column(2).cast(pa.int32()), "hits": pa.array(hits, pa.list_(pa.int32()))})

    stems = sorted(chosen)
    documents: list[list[set[int]]] = [[set() for _ in stems], [set() for _ in stems]]
    rows = sample.select("doc_id", "text", "toxic").mapInArrow(releasing(fired), "toxic int, hits array<int>").where("size(hits) > 0")
    for n, r in enumerate(rows.collect()):  # of the bounded sample
        for i in r["hits"]:
            documents[r["toxic"]][i].add(n)
    need = Counter({n: COVER for n in set().union(*documents[1])})
    picked: list[int] = []
    wrong: set[int] = set()
    while len(picked) < most:
        open_ = [i for i in range(len(stems)) if not any(
            stems[i].text.startswith(stems[j].text) or stems[j].text.startswith(stems[i].text) for j in picked)]
        gain = lambda i: sum(need[n] > 0 for n in documents[1][i]) - 4 * len(documents[0][i] - wrong)
        best = max(open_, key=lambda i: (gain(i), len(stems[i].text), stems[i].text), default=None)
        if best is None or gain(best) < least:
            break
        picked.append(best)
        need.subtract(documents[1][best])
        wrong |= documents[0][best]
    return sorted({s for i in picked for s in (stems[i], Stem(stems[i].text, True))})


# --- votes -----------------------------------------------------------------------------------

class Voters:
    """The bit pattern of a text: stems, patterns, then counts and densities of hits."""

    def __init__(self, stems: list[Stem]):
        self.stems = stems
        self.names = sorted({s.text for s in self.stems})
        self.votes = len(self.stems) + len(PATTERNS)
        self.bits = self.votes + len(COUNTS) + len(DENSITIES)
        by_text = {t: k for k, t in enumerate(self.names)}
        sizes = sorted({len(t) for t in self.names})

        class Known(dict):
            def __missing__(self, token):
                found = tuple((by_text[w[:n]], w) for w in _letters.findall(token) for n in sizes
                              if len(w) >= n and w[:n] in by_text) or None
                if len(self) < KNOWN_WORDS:
                    self[token] = found
                return found

        self.known = Known()

    def pattern(self, text: str) -> list[int]:
        tokens = text.lower().split()
        times, forms = Counter(), {}
        hits = 0
        for found in filter(None, map(self.known.__getitem__, tokens)):
            hits += 1
            for k, word in found:
                times[k] += 1
                forms.setdefault(k, set()).add(word)
        bits = 0
        for i, s in enumerate(self.stems) if times else ():
            k = self.names.index(s.text)
            if times[k] and (not s.repeated or len(forms[k]) > 1 and times[k] * WORDS_PER_HIT >= len(tokens)):
                bits |= 1 << i
        at = len(self.stems)
        if text.count("!") * 20 >= max(len(tokens), 20):
            bits |= 1 << (at + 1)
        if _shout.search(text) and len(_shout.findall(text)) * 4 >= max(len(tokens), 8):
            bits |= 1 << at
        if ("*" in text or "#" in text or "$" in text or "@" in text) and _masked.search(text):
            bits |= 1 << (at + 2)
        if not times:
            bits |= 1 << (at + 3)
        at = self.votes
        different = len(set().union(*forms.values())) if forms else 0
        for n in COUNTS:
            bits |= (different >= n) << at
            at += 1
        for n in DENSITIES:
            bits |= (hits > 0 and hits * n >= len(tokens)) << at
            at += 1
        return [bits >> at & (1 << WORD_BITS) - 1 for at in range(0, self.bits, WORD_BITS)]


def vote(docs: DataFrame, stems: list[Stem]) -> DataFrame:
    """``docs`` (doc_id, rid, text) -> (doc_id, rid, pattern array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(stems)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch({"doc_id": part.column(0), "rid": part.column(1), "pattern": pa.array(
                    list(map(voters.pattern, part.column(2).to_pylist())), pa.list_(pa.int64()))})

    return docs.mapInArrow(releasing(run), "doc_id long, rid long, pattern array<long>")


# --- label model and classifier ---------------------------------------------------------------

def _unpack(patterns: np.ndarray, bits: int) -> np.ndarray:
    """[row, bit] of patterns [row, word]."""
    at = np.arange(bits)
    return ((patterns[:, at // WORD_BITS] >> at % WORD_BITS) & 1).astype(np.float64)


def add_up(patterns: DataFrame, per_batch) -> np.ndarray:
    """Sum over all (pattern, label, count) rows of the fixed-length vector that ``per_batch``
    makes of a batch (label: 0, 1 or -1 for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                words = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                v = per_batch(words, *(np.asarray(batch.column(i)) for i in (1, 2)))
                total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch({"i": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total)})

    rows = patterns.mapInArrow(releasing(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class LabelModel:
    prior: float  # log odds of label 1
    fire: np.ndarray  # [label, voter]: how often the voter fires
    share: np.ndarray  # weight of a voter after its correlations

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """A voter that doesn't fire abstains: it says nothing about the label."""
        return self.prior + x @ (np.log(self.fire[1] / self.fire[0]) * self.share)


def fit_label_model(patterns: DataFrame, votes: int, rounds: int = ROUNDS) -> LabelModel | None:
    """EM over the vote patterns; None when the labels lack a class."""

    def sums(p, x, n):
        out = []
        for w in ((1 - p) * n, p * n):
            out += [[w.sum()], x.T @ w, ((x * w[:, None]).T @ x).ravel()]
        return np.concatenate(out)

    def labelled_only(pattern, label, n):
        return sums(label == 1, _unpack(pattern, votes), n * (label >= 0))

    def step(model):
        def run(pattern, label, n):
            x = _unpack(pattern, votes)
            p = np.where(label >= 0, label, _sigmoid(model.log_odds(x)))
            return sums(p, x, n)
        return run

    def model_of(total) -> LabelModel:
        size = 1 + votes + votes * votes
        fire, correlation = np.zeros((2, votes)), np.zeros((votes, votes))
        weight = [total[0], total[size]]
        for y in (0, 1):
            part = total[y * size: (y + 1) * size]
            fire[y] = (part[1: 1 + votes] + 0.5 * (0.2 + 0.6 * y)) / (part[0] + 0.5)
            mean = part[1: 1 + votes] / max(part[0], 1e-9)
            both = part[1 + votes:].reshape(votes, votes) / max(part[0], 1e-9)
            deviation = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
            rho = (both - np.outer(mean, mean)) / np.outer(deviation, deviation)
            correlation = np.maximum(correlation, np.where(rho > SAME, np.minimum(rho, 1), 0))
        np.fill_diagonal(correlation, 0)
        return LabelModel(float(np.log((weight[1] + 0.5) / (weight[0] + 0.5))), np.clip(fire, 1e-6, 1 - 1e-6),
                          1 / (1 + correlation.sum(axis=0)))

    total = add_up(patterns, labelled_only)
    if not len(total) or min(total[0], total[1 + votes + votes * votes]) < 1:
        return None
    model = model_of(total)
    for _ in range(rounds):
        before, model = model, model_of(add_up(patterns, step(model)))
        if np.abs(model.fire - before.fire).max() < 1e-5:
            break
    return model


def fit_classifier(patterns: DataFrame, model: LabelModel, votes: int, bits: int, penalty: float = 1.0) -> np.ndarray:
    """Logistic weights (the last one is the intercept) on the posterior labels."""
    w = np.zeros(bits + 1)

    def step(pattern, label, n):
        x = _unpack(pattern, bits)
        soft = np.where(label >= 0, label, _sigmoid(model.log_odds(x[:, :votes])))
        x = np.c_[x, np.ones(len(x))]
        p = _sigmoid(x @ w)
        return np.r_[x.T @ (n * (soft - p)), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()]

    ridge = penalty * np.r_[np.ones(bits), 0]
    for _ in range(ROUNDS):
        total = add_up(patterns, step)
        gradient = total[: bits + 1] - ridge * w
        move = np.linalg.solve(total[bits + 1:].reshape(bits + 1, -1) + np.diag(ridge + 1e-6), gradient)
        w = w + np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-3:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ...) and ``labels`` (doc_id, toxic, ...) -> (doc_id, rid, held_out, score,
    predicted), one row for each row of ``docs``; ``rid`` is the hash of the text.

    Only the text is scored. Labels other than 0 and 1 are ignored. Null and empty texts are scored
    like texts without a vote; null doc_ids are not held out and not learned from; repeated rows
    come out as often as they came in. Without labels of both classes every score is 0. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("rid"),
                       text_or_empty().alias("text"))
    stems = induce_stems(labelled_sample(rows, labels))
    voters = Voters(stems)
    voted = materialise(vote(rows, voters.stems), "votes")

    known = (labels.where(in_training()).where("toxic in (0, 1)").groupBy("doc_id")
             .agg(F.max("toxic").cast("long").alias("label")))
    patterns = materialise(
        voted.where(in_training()).join(known, "doc_id", "left")
        .groupBy("pattern", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n")), "patterns")
    model = fit_label_model(patterns, voters.votes)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    if model is None:
        value = F.lit(0.0)
    else:
        w = fit_classifier(patterns, model, voters.votes, voters.bits)
        odds = F.lit(float(w[-1]))
        for i in range(voters.bits):
            odds = odds + F.when(F.getbit(F.col("pattern")[i // WORD_BITS], F.lit(i % WORD_BITS)) == 1, float(w[i])).otherwise(0.0)
        value = 1 / (1 + F.exp(-odds))
    return (voted.select("doc_id", "rid", held_out.alias("held_out"), value.alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def without_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows predicted toxic; equal texts have one verdict."""
    rid, = free_names(docs, "_rid")
    rejected = materialise(score(docs, labels, **parameters).where("predicted = 1").select(F.col("rid").alias(rid)).distinct(), "toxic")
    return docs.withColumn(rid, F.xxhash64(text_or_empty())).join(rejected, rid, "left_anti").select(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rid")
