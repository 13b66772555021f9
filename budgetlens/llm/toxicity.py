"""Toxicity by a weighted finite-state pattern grammar.

Clauses, not words, are scored. A clause is a string of word classes; three
weighted transducers read it, composed into one machine:

* scope: after a negation the next words are weakened, after a verb of
  reported speech the rest of the clause is, after an opening quote all words
  up to the closing one or the clause's end;
* address: remembers whether a target (you, they, names of groups) was met and
  whether only link words followed it;
* pattern: gives an insult its weight, more when it is aimed at a target, and
  a threat verb a weight when a target follows.

The lexicon of insult words is a short list of seeds plus words and word stems
learned from labelled training rows, each with its log-odds as weight. A
document's score is a logistic function of its clause scores, fitted on
labelled training rows that the lexicon was not learned from.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import doc_bucket, each_text, in_arrow, map_batches, release, stored

#: Word classes.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, LINK, BREAK, OPEN, CLOSE = range(10)
#: Seeds of the lexicon (fixed values).
SEEDS = {
    INSULT: "idiot moron stupid imbecile loser scum trash garbage vermin worthless pathetic disgusting "
            "clown dumb fool filth filthy subhuman",
    THREAT: "kill hurt destroy beat stab shoot burn hang strangle punish",
    TARGET: "you your yourself u he she him her they them these those people folks guys du ihr vous tu toi ustedes "
            "eres immigrants foreigners",
    NEGATION: "not no never neither nor without isn aren don won nicht kein nie pas jamais nunca sin",
    REPORT: "said says say called calls wrote writes quoted quote claimed claims reported reports according "
            "sagte dit dijo",
    LINK: "are is re am be a an the such so really very total complete absolute utterly will going to gonna must "
          "should ll all just bunch of et and",
}
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”„«»]")
#: A quote at the front of a word opens; the other marks of that kind close.
OPENING = re.compile(r"(?<![^\s(\[])(?:[\"“”„»](?=\w)|«)")
OPENED, CLOSING = "„", "\"“”«»"
#: Stem lengths that the lexicon considers.
STEMS = range(5, 9)
#: Distinct terms that a task counts before it hands its counts on.
FLUSH_TERMS = 300_000


class Transducer:
    """Deterministic weighted transducer: (state, class) gives the next state,
    the class to pass on and a factor; what is not listed stays in
    ``default(state, class)``."""

    def __init__(self, states: int, arcs: dict, default):
        self.states = states
        self.arc = {(s, c): arcs.get((s, c)) or default(s, c) for s in range(states) for c in range(CLOSE + 1)}

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one passes on is read by ``other``; factors multiply."""
        n = other.states

        def joint(s, c):
            a, out, f = self.arc[s // n, c]
            b, last, g = other.arc[s % n, out]
            return a * n + b, last, f * g

        return Transducer(self.states * n, {}, joint)


def scope(weak: float = 0.35, span: int = 3) -> Transducer:
    """State: 0 plain, 1..span after a negation, span + 1 inside reported speech,
    span + 2 between quotes."""
    told, quoted = span + 1, span + 2
    arcs = {}
    for s in range(span + 3):
        arcs[s, BREAK] = (0, BREAK, 1.0)
        arcs[s, OPEN] = (told if s == told else quoted, OTHER, 1.0)
        arcs[s, CLOSE] = (0 if s == quoted else s, OTHER, 1.0)
        if s != quoted:
            arcs[s, REPORT] = (told, OTHER, 1.0)
        if s < told:
            arcs[s, NEGATION] = (1, OTHER, 1.0)

    def rest(s, c):
        if s >= told:
            return s, c, weak
        return (s + 1 if 0 < s < span else 0), c, (weak if s else 1.0)

    return Transducer(span + 3, arcs, rest)


def address(aimed: float = 1.6) -> Transducer:
    """State 1: a target was met and only link words since; an insult there is aimed."""
    arcs = {(s, TARGET): (1, TARGET, 1.0) for s in (0, 1)}
    arcs |= {(1, LINK): (1, LINK, 1.0), (1, INSULT): (1, INSULT, aimed), (0, INSULT): (0, INSULT, 1.0)}
    return Transducer(2, arcs, lambda s, c: (0, c, 1.0))


def pattern() -> Transducer:
    """State 1: a threat verb was met; a target that follows completes the threat."""
    arcs = {(0, THREAT): (1, OTHER, 0.0), (1, THREAT): (1, OTHER, 0.0), (1, LINK): (1, OTHER, 0.0),
            (1, TARGET): (0, THREAT, 1.0)}
    return Transducer(2, arcs, lambda s, c: (0, c if c == INSULT else OTHER, 1.0 if c == INSULT else 0.0))


GRAMMAR = scope().then(address()).then(pattern())
THREAT_WEIGHT = 1.0


class Lexicon(dict):
    """Word to (class, weight), by whole word or else by its longest known stem;
    a cache that starts afresh when it is full."""

    def __init__(self, words: dict[str, tuple[int, float]], stems: dict[str, float], most: int = 100_000):
        super().__init__()
        self.words, self.stems, self.most = words, stems, most

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        got = self.words.get(word)
        if got is None:
            got = (OTHER, 0.0)
            if word in ".!?;:\n":
                got = (BREAK, 0.0)
            elif word == OPENED:
                got = (OPEN, 0.0)
            elif word in CLOSING:
                got = (CLOSE, 0.0)
            else:
                for k in reversed(STEMS):
                    if len(word) > k and word[:k] in self.stems:
                        got = (INSULT, self.stems[word[:k]])
                        break
        self[word] = got
        return got

    def __reduce__(self):
        return Lexicon, (self.words, self.stems, self.most)


def clause_scores(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """The scores of the clauses that the grammar matches, and the number of words."""
    tokens = TOKEN.findall(OPENING.sub(OPENED, text.lower()))
    found = list(map(lexicon.__getitem__, tokens))
    scores, state, score = [], 0, 0.0
    if any(c == INSULT or c == THREAT for c, _ in found):
        arc = GRAMMAR.arc
        for c, w in found:
            state, out, f = arc[state, c]
            if c == BREAK:
                if score:
                    scores.append(score)
                state, score = 0, 0.0
            elif out == INSULT:
                score += f * w
            elif out == THREAT:
                score += f * THREAT_WEIGHT
        if score:
            scores.append(score)
    return scores, len(tokens)


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """Best clause, sum over clauses (damped), and matched weight per word."""
    scores, n = clause_scores(text, lexicon)
    total = sum(scores)
    return np.array([1.0, max(scores, default=0.0), np.log1p(total), 100 * total / (n + 20)])


class Model:
    """Lexicon and the weights of the logistic function."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, center: np.ndarray, scale: np.ndarray):
        self.lexicon, self.weights, self.center, self.scale = lexicon, weights, center, scale

    def score(self, text: str) -> float:
        x = (features(text, self.lexicon) - self.center) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40))))


def terms(text: str) -> set[str]:
    """The distinct words of a text, and with a closing star their stems."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def labelled(docs: DataFrame, labels: DataFrame, modulus: int, most: int | None = None) -> DataFrame:
    """(part, toxic, text) of all labelled training documents. Ids whose crc32
    leaves remainder 0 are left out; a doc_id with contrary labels counts as
    toxic. ``most``: the documents of so many ids only, the ones that hash lowest."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
           .filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
           .withColumn("part", doc_bucket("id", modulus)).filter("part <> 0"))
    if most is not None:
        ids = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
            .filter((doc_bucket("id", modulus) != 0) & F.col("text").isNotNull()))
    # Labels grow with the documents: a join by shuffles at every size.
    return stored(rows.join(ids.hint("merge"), "id").select("part", "toxic", "text"), "labelled")


def learn_lexicon(rows: DataFrame, min_docs: int, min_odds: float, most: int) -> Lexicon:
    """Seeds and the learned terms: at least ``min_docs`` toxic documents and
    log-odds of ``min_odds``; at most ``most`` terms, the strongest first."""
    def count(batch):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for toxic, text in zip(batch.column("toxic").to_pylist(), each_text(batch), strict=True):
            for t in terms(text):
                seen[t][toxic > 0] += 1
            if len(seen) > FLUSH_TERMS:
                yield _counts(seen)
                seen.clear()
        yield _counts(seen)

    def _counts(seen):
        return {"term": list(seen), "clean": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()]}

    n = {r["t"]: r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    a, b = n.get(True, 0), n.get(False, 0)
    odds = (F.log((F.col("toxic") + 0.5) / (a + 1 - F.col("toxic"))) -
            F.log((F.col("clean") + 0.5) / (b + 1 - F.col("clean"))))
    got = (map_batches(rows.select("toxic", "text"), count, "term string, clean long, toxic long", bounded=True)
           .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
           .filter(F.col("toxic") >= min_docs).withColumn("odds", odds).filter(F.col("odds") >= min_odds)
           .orderBy(F.desc("odds"), "term").limit(most).collect())
    words = {w: (c, 1.0) for c, ws in SEEDS.items() for w in ws.split()}
    stems = {}
    for r in got:
        weight = r["odds"] / 4
        if r["term"].endswith("*"):
            stems[r["term"][:-1]] = weight
        elif words.get(r["term"], (INSULT,))[0] == INSULT:
            words[r["term"]] = (INSULT, weight)
    return Lexicon(words, stems)


def fit(rows: DataFrame, size: int, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised columns; the
    first of the ``size`` columns is the constant. ``rows``: (y int, x array of
    double). A step adds up the gradient and the Hessian over all rows in Spark;
    only these sums come to the driver."""
    x = [F.col("x")[k] for k in range(size)]
    got = rows.agg(*map(F.avg, x), *map(F.stddev_pop, x)).first()
    center, scale = np.array(got[:size]), np.array(got[size:]) + 1e-9
    center[0], scale[0] = 0.0, 1.0
    z, w = [(c - float(m)) / float(d) for c, m, d in zip(x, center, scale, strict=True)], np.zeros(size)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    penalty = np.full(size, ridge)
    penalty[0] = 1e-3
    z = rows.select(F.when(F.col("y") > 0, 1.0).otherwise(0.0).alias("y"), *[c.alias(f"z{k}") for k, c in enumerate(z)])
    for _ in range(30):
        at = sum((F.col(f"z{k}") * float(v) for k, v in enumerate(w)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(40.0)), F.lit(-40.0))))
        sums = z.select("*", p.alias("p")).agg(
            *[F.sum((F.col("p") - F.col("y")) * F.col(f"z{k}")) for k in range(size)],
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}") * (F.col("p") * (1 - F.col("p")) + 1e-6)) for i, j in pairs]).first()
        h = np.diag(penalty)
        for (i, j), v in zip(pairs, sums[size:], strict=True):
            h[i, j] += v
            h[j, i] = h[i, j]
        step = np.linalg.solve(h, np.array(sums[:size]) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, center, scale


def train(docs: DataFrame, labels: DataFrame, most_rows: int | None = None, modulus: int = 5,
          min_docs: int = 3, min_odds: float = 2.5, most_terms: int = 4_000) -> Model:
    """Learn from all labelled rows (``most_rows``: from the rows of so many ids
    only): the lexicon from the remainders 1 to ``modulus`` - 2, the logistic
    function from the last one, so that its scores are honest ones. Without
    labels of both kinds the seeds stand alone with fixed weights."""
    rows = labelled(docs, labels, modulus, most_rows)
    release(docs.sparkSession)  # the shuffled texts go before terms are counted
    lexicon = learn_lexicon(rows.filter(F.col("part") < modulus - 1), min_docs, min_odds, most_terms)

    def measure(batch):
        x = np.array([features(t, lexicon) for t in each_text(batch)])
        return {"y": batch.column("toxic"), "x": list(x)}

    got = stored(map_batches(rows.filter(F.col("part") == modulus - 1).select("toxic", "text"), measure,
                             "y int, x array<double>", bounded=True), "features")
    n = {r["t"]: r["count"] for r in got.groupBy((F.col("y") > 0).alias("t")).count().collect()}
    if len(n) < 2 or sum(n.values()) < 20:
        return Model(lexicon, np.array([-2.0, 1.0, 2.0, 0.5]), np.zeros(4), np.ones(4))
    return Model(lexicon, *fit(got, 4))


def score(docs: DataFrame, model: Model, modulus: int = 5) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted).

    Defined cases: a null text counts as empty and gets the score of a text
    without matches; a null id counts as the empty text for held_out; repeated
    rows come back as often as they occur; other columns are not read.
    """
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (doc_bucket("doc_id", modulus) == 0).alias("held_out"), F.col("text").alias("text"))

    def run(batch):
        s = [model.score(t) for t in each_text(batch)]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s,
                "predicted": [int(v >= 0.5) for v in s]}

    return map_batches(pick, run, "doc_id long, held_out boolean, score double, predicted int", bounded=True)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, all columns unchanged."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < 0.5 for t in each_text(batch)], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
