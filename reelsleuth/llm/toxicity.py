"""Toxicity by a weighted finite-state grammar over clauses, its insult patterns and weights learnt from labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled rows to learn from, at most: toxic and clean ones.
LEARN_TOXIC, LEARN_CLEAN = 4000, 8000
#: A pattern is kept that occurs in so many toxic rows at least and whose log odds, less their deviation, come to so much.
LEAST_ROWS, LEAST_ODDS = 3, 1.2
AFFIXES = (4, 5, 6, 7)

# Words that shift the sense of a clause, in English, German, French and Spanish.
NEGATION = frozenset("not never no don't isn't aren't nicht kein keine keinen niemals ne pas jamais aucun nunca jamás ningún".split())
REPORTED = frozenset("said says wrote quoted quote called calls reported allegedly sagte sagt schrieb zitierte angeblich disait écrit cité prétendument dijo escribió citó supuestamente".split())
TARGET = frozenset("you your you're u ya du dich dir dein deine ihr euch tu te toi ton vous votre tú tu usted ustedes vosotros".split())
INTENT = frozenset("will shall going gonna i'll we'll werde werden wird vais va allons voy vamos va".split())
THREAT = frozenset("kill murder destroy hurt shoot stab strangle umbringen töten erschießen erstechen vernichten tuer assassiner égorger frapper matar asesinar golpear apuñalar".split())

CLAUSE = re.compile(r"[^.!?;:,\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
QUOTE = re.compile(r"[\"“”«»]")


@dataclass(frozen=True)
class Transducer:
    """A deterministic finite-state transducer: (state, symbol) to (state, output). A symbol without an arc is
    copied and leads to `otherwise[state]`, or stays."""

    arcs: dict
    otherwise: dict = field(default_factory=dict)

    def step(self, state, symbol: str):
        if (found := self.arcs.get((state, symbol))) is not None:
            return found
        return self.otherwise.get(state, state), symbol


def compose(*machines: Transducer) -> Transducer:
    """The transducer that feeds each machine's output to the next, with all reachable states written out."""
    symbols, start = sorted({s for m in machines for _, s in m.arcs} | {"O"}), (0,) * len(machines)
    outs = {o for m in machines for _, o in m.arcs.values()}
    arcs, seen, todo = {}, {start}, [start]
    while todo:
        state = todo.pop()
        for symbol in sorted({*symbols, *outs}):
            now, out = [], symbol
            for m, s in zip(machines, state):
                t, out = m.step(s, out)
                now.append(t)
            arcs[state, symbol] = (tuple(now), out)
            if tuple(now) not in seen:
                seen.add(tuple(now))
                todo.append(tuple(now))
    return Transducer(arcs)


def insults(weights: dict[str, float]) -> Transducer:
    """Words to I, each pattern's weight aside; the others to their class or to O."""
    classes = [("N", NEGATION), ("R", REPORTED), ("T", TARGET), ("H", THREAT), ("M", INTENT)]
    return Transducer({(0, w): (0, c) for c, words in classes for w in words} | {(0, w): (0, "I") for w in weights})


def grammar() -> Transducer:
    """Insults (I) and threats (H, and S after words of intent), marked by what precedes them in their clause.

    Intent and negation hold for three words, reported speech and a target to the clause's end. An insult leaves as I, In
    (negated), Ir (reported) or It (aimed at someone), a threat as H, Hn, Hr, Ht or S, Sn, Sr, St.
    """
    reach = 3
    fade = {k: k - 1 for k in range(1, reach + 1)}
    threat = {(k, "M"): (reach, "M") for k in range(reach + 1)} | {(k, "H"): (k - 1, "S") for k in range(1, reach + 1)}
    negated = {(k, "N"): (reach, "N") for k in range(reach + 1)}
    negated |= {(k, s): (k - 1, f"{s}n") for k in range(1, reach + 1) for s in "IHS"}
    reported = {(k, "R"): (1, "R") for k in (0, 1)} | {(1, s): (1, f"{s[0]}r") for s in ("I", "H", "S", "In", "Hn", "Sn")}
    aimed = {(k, "T"): (1, "T") for k in (0, 1)} | {(1, s): (1, f"{s}t") for s in "IHS"}
    return compose(Transducer(threat, fade), Transducer(negated, fade), Transducer(reported), Transducer(aimed))


# What an output adds to its clause, times the pattern's weight; a threat's own weight is THREAT_WEIGHT.
OUTPUTS = {"I": 1.0, "In": 0.3, "Ir": 0.3, "It": 1.3, "H": 0.4, "Hn": 0.1, "Hr": 0.1, "Ht": 1.0, "S": 0.8, "Sn": 0.2, "Sr": 0.2, "St": 1.6}
THREAT_WEIGHT = 2.0
FEATURES = 5


def keys_of(word: str) -> list[str]:
    """The patterns that a word can match: itself, and each start and end of it."""
    n = len(word)
    return [word] + [f"{word[:k]}-" for k in AFFIXES if k < n] + [f"-{word[-k:]}" for k in AFFIXES if k < n]


class Scorer:
    """Patterns and weights. score() reads whole texts, clause by clause."""

    def __init__(self, patterns: dict[str, float], weights: list[float], bias: float) -> None:
        self.patterns, self.weights, self.bias = patterns, np.array(weights), bias

    def prepare(self) -> None:
        self.machine, self.classes, self.known = grammar().arcs, insults({}).arcs, {}

    def kind(self, word: str) -> tuple[str, float]:
        """Class and weight of a word, of its patterns the heaviest; what was looked up is kept, up to a bound."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            weight = max((self.patterns[k] for k in keys_of(word) if k in self.patterns), default=0.0)
            symbol = "I" if weight else self.classes.get((0, word), (0, "O"))[1]
            found = self.known[word] = symbol, weight or (THREAT_WEIGHT if symbol == "H" else 0.0)
        return found

    def clauses(self, text: str | None) -> list[float]:
        """The scores of the clauses that hold an insult or a threat: what the grammar's outputs sum to in each."""
        out = []
        for clause in CLAUSE.finditer((text or "").lower()):
            said = clause.group()
            kinds = [self.kind(w) for w in WORD.findall(said)]
            if not any(x for _, x in kinds):
                continue
            state = (0, 0, 0, 0)
            if len(QUOTE.findall(said)) > 1:
                state, _ = self.machine[state, "R"]
            total = 0.0
            for symbol, weight in kinds:
                state, marked = self.machine[state, symbol]
                total += weight * OUTPUTS.get(marked, 0.0)
            out.append(total)
        return out

    def features(self, text: str | None) -> np.ndarray:
        """The worst clause, the four next, all of them damped, how many there are for the text's length, and that length."""
        found = sorted(self.clauses(text), reverse=True)
        size = 1 + len(text or "") / 100
        return np.array([found[0] if found else 0.0, sum(found[1:5]), np.log1p(sum(found)), np.log1p(sum(found) / size), np.log(size)])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.features(text) @ self.weights, -30, 30))))


def pattern_weight(a, b, toxic: int, clean: int):
    """Log odds of a pattern in `a` of so many toxic and `b` of so many clean rows, less their deviation."""
    return np.log((a + 0.5) / (toxic + 1)) - np.log((b + 1) / (clean + 1)) - np.sqrt(1 / (a + 0.5) + 1 / (b + 1))


def fit_weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, each halved until it gains, drawn towards `prior` weights; row weights are even."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.append(prior, -3.0)
    pull = np.append(np.full(x.shape[1], ridge), 1e-3)
    centre = w.copy()

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (pull * (w - centre) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pull * (w - centre)
        hess = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if now - then < 1e-9:
            break
        w, now = w - step, then
    return w[:-1], float(w[-1])


#: Weights of features() before any label is seen.
PRIOR = np.array([0.4, 0.2, 0.3, 0.3, -0.1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """A Scorer from the labelled rows whose crc32(doc_id) mod 3 isn't 1.

    At most LEARN_TOXIC and LEARN_CLEAN rows are drawn by a hash of doc_id. Of rows that share the least hash
    of their word triples (near copies), one counts. Patterns are words and their starts and ends, weighed by
    pattern_weight(); weak ones stay, and the weights of clauses decide. Those are fitted on features that each half of the rows gets
    from the other half's patterns, so that a chance pattern doesn't vouch for its own rows. Without toxic or clean rows no pattern is kept.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [r for t, n in ((1, LEARN_TOXIC), (0, LEARN_CLEAN)) for r in usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if not drawn:
        return Scorer({}, list(PRIOR), -3.0)
    chosen = F.broadcast(spark.createDataFrame(drawn, "doc_id long, toxic int"))  # LEARN_TOXIC + LEARN_CLEAN rows at most

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            least, keys = [], []
            for text in batch["text"]:
                words = WORD.findall((text or "").lower())
                least.append(min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2))), default=0))
                keys.append(sorted({k for w in set(words) for k in keys_of(w)}))
            yield pd.DataFrame({"toxic": batch["toxic"], "least": least, "text": batch["text"], "keys": keys})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    seen = own.select("toxic", "text").mapInPandas(read, "toxic int, least long, text string, keys array<string>").dropDuplicates(["least", "toxic"])
    seen = cut(seen.withColumn("half", F.pmod(F.xxhash64("least"), F.lit(2)).cast("int")))
    n = {(r["toxic"], r["half"]): r["n"] for r in seen.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (np.array([n.get((t, h), 0) for h in (0, 1)]) for t in (1, 0))
    if not toxic.sum() or not clean.sum():
        return Scorer({}, list(PRIOR), -3.0)
    count = lambda t, h: F.sum(((F.col("toxic") == t) & (F.col("half") == h)).cast("int"))
    counts = seen.select("toxic", "half", F.explode("keys").alias("key")).groupBy("key").agg(*[count(t, h).alias(f"{'ba'[t]}{h}") for t in (0, 1) for h in (0, 1)])
    # No more than the words of LEARN_TOXIC rows, and those of three rows only.
    few = counts.where((F.col("a0") + F.col("a1") >= LEAST_ROWS) & (F.col("b0") + F.col("b1") <= F.lit(float(clean.sum() / toxic.sum())) * (F.col("a0") + F.col("a1")))).orderBy("key").toPandas()

    def patterns(halves: list[int]) -> dict[str, float]:
        a, b = (few[[f"{x}{h}" for h in halves]].sum(axis=1).to_numpy(float) for x in "ab")
        weight = pattern_weight(a, b, int(toxic[halves].sum()), int(clean[halves].sum()))
        kept = (a >= LEAST_ROWS) & (weight >= LEAST_ODDS)
        return dict(zip(few["key"][kept], weight[kept].tolist()))

    scorers = [Scorer(patterns([1 - h]), list(PRIOR), -3.0) for h in (0, 1)]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for scorer in scorers:
            scorer.prepare()
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [scorers[h].features(t).tolist() for h, t in zip(batch["half"], batch["text"])]})

    rows = seen.select("toxic", "half", "text").mapInPandas(weigh, "toxic int, x array<double>").orderBy("toxic", "x").collect()
    weights, bias = fit_weights(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), PRIOR)
    return Scorer(patterns([0, 1]), list(weights), bias)


def held_out(doc_id):
    """Whether a row's label is kept from learning; false for a null doc_id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`: score is 0 to 1, predicted 1 from `threshold` on.

    Null and empty texts get the score of a text without matches. Equal texts get equal scores. Repeated rows
    appear again; a null doc_id isn't held out; an empty table gives no rows; other columns are ignored.
    """
    scorer = learn(docs, labels, id_col, text_col)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer.prepare()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)
        scorer.known.clear()

    apply = F.pandas_udf("double")(score)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), apply(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
