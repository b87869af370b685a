"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Terms: whole words and word stems (leading letters) that speak for toxic text are mined from a
   bounded sample of labelled rows; general insults are added as a fixed word list.
2. Voters: each lexicon voter holds a share of the words, each pattern voter a share of the stems or
   a form of writing. A voter votes on a whole text. Votes are counted as patterns over all
   documents: 2 ** voters rows at most, however many documents there are.
3. Label model: a two-class mixture fitted by expectation maximisation on the pattern counts. It
   estimates each voter's accuracy in either class and the correlations of voters: a tree of the
   strongest dependencies (conditional mutual information) is part of the model, so that voters
   which repeat each other do not count twice. Known labels are one more voter, where there are any.
4. Classifier: logistic regression on the words and stems that matter and on the votes, trained on the
   posterior labels of the sample's rows. Its probability is the score.

Labels are read from the rows given as `labels` only; ids, languages and sources are no features.

Defined cases: null and empty texts have no features and get the score of the intercept; repeated
rows are scored alike; null ids are scored and never trained on; texts are scored whole; without
labelled rows of both classes the fixed list and the forms of writing make the voters, and the label
model's posterior is the score; an empty table gives an empty result; columns pass through on request.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches

#: Labelled rows that terms, labels and the classifier are fitted on, chosen by a hash of the text.
SAMPLE_ROWS = 20_000
#: Tasks that work on the sample.
SAMPLE_TASKS = 32
#: Mined words and stems, and features of the classifier.
TERMS, FEATURES = 400, 4096
#: Letters of a stem; only longer words have one.
STEMS = (4, 5, 6)
LEXICONS, PATTERNS = 6, 4

# General insults, in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb ugly bastard "
    "bitch asshole jerk freak filth vermin imbecile retard hate "
    "dummkopf arschloch trottel abschaum wertlos ekelhaft versager widerlich "
    "imbécile crétin ordure connard salaud abruti "
    "idiota imbécil estúpido basura escoria asqueroso inútil perdedor".split()
)

_word = re.compile(r"[^\W\d_]+").findall
_shout = re.compile(r"\b[^\W\d_a-z]{4,}!{2,}").search
_masked = re.compile(r"\b[a-z][*#@$]{2,}[a-z]*\b", re.I).search


def terms(text: str | None) -> set[str]:
    """Lower-cased words, and stems written with a trailing dash."""
    words = set(_word((text or "").lower()))
    return words.union(*[{w[:k] + "-" for w in words if len(w) > k} for k in STEMS])


def _count_terms(rows: DataFrame) -> DataFrame:
    """(term, toxic, docs) counts over labelled texts, summed per batch before the shuffle."""

    def run(text, toxic):
        seen = Counter((t, y) for x, y in zip(text, toxic) for t in terms(x))
        keys = list(seen)
        return {"term": [t for t, _ in keys], "toxic": [y for _, y in keys], "docs": [seen[k] for k in keys]}

    counts = map_batches(rows.select("text", F.col("toxic").cast("int").alias("toxic")), run, "term string, toxic int, docs long")
    return counts.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("c"),
    )


def mine(sample: DataFrame, toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Terms that speak for toxic text, best first, and the classifier's features (these terms included).

    Ranked by how far a term's share of the toxic rows exceeds chance, per pooled standard error.
    """
    if not toxic or not clean:
        return [], sorted(INSULTS)
    # Only terms that differ clearly between the classes; the others would add noise to long texts.
    share_t, share_c = F.col("t") / toxic, F.col("c") / clean
    pooled = (F.col("t") + F.col("c") + 1) / (toxic + clean + 2)
    z = (share_t - share_c) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / clean))
    lift = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    scored = _count_terms(sample).where("t + c >= 3").select("term", z.alias("z"), lift.alias("lift"))
    top = scored.where("abs(z) >= 4").orderBy(F.desc(F.abs("z")), "term").limit(FEATURES).collect()  # FEATURES rows
    for_toxic = [r["term"] for r in sorted(top, key=lambda r: (-r["z"], r["term"])) if r["z"] >= 3 and r["lift"] >= 1.5]
    return for_toxic[:TERMS], sorted({r["term"] for r in top} | INSULTS)


def voters(found: list[str]) -> list[frozenset[str]]:
    """Lexicon voters over words, pattern voters over stems; terms are dealt out in turn by rank."""
    words = [t for t in found if t[-1] != "-"]
    stems = [t for t in found if t[-1] == "-"]
    made = [frozenset(words[k::LEXICONS]) for k in range(LEXICONS)] + [frozenset(stems[k::PATTERNS]) for k in range(PATTERNS)]
    return [v for v in made if v] + [INSULTS]


def vote(docs: DataFrame, lexicons: list[frozenset[str]], features: list[str], keep: Iterable[str]) -> DataFrame:
    """`keep` columns, votes (a bit per voter; the last two are forms of writing) and active features.

    Features are the given terms, then the votes themselves: a rare term speaks through its voter.
    """
    place = {t: i for i, t in enumerate(features)}
    known = frozenset(place)
    voting = frozenset().union(*lexicons)
    keep = list(keep)

    def run(**columns):
        votes, active = [], []
        for text in columns.pop("__text"):
            seen = terms(text)
            said = seen & voting
            bits = sum(1 << k for k, lexicon in enumerate(lexicons) if not lexicon.isdisjoint(said)) if said else 0
            bits |= bool(text and _shout(text)) << len(lexicons) | bool(text and _masked(text)) << len(lexicons) + 1
            votes.append(bits)
            fired = [len(place) + k for k in range(bits.bit_length()) if bits >> k & 1]
            active.append(sorted(place[t] for t in seen & known) + fired)
        return columns | {"votes": votes, "active": active}

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select(*keep, docs["text"].alias("__text")), run, f"{kinds}votes int, active array<int>", 500)


class LabelModel:
    """P(class) and P(votes | class) with a tree of dependent voters.

    accuracy: P(vote | class) per voter, as rows (clean, toxic); parent: the voter each depends on,
    or -1; correlation: of the linked voters' votes, given the class.
    """

    def __init__(self, count: int, prior: float):
        self.count, self.prior = count, prior

    def fit(self, votes: np.ndarray, weight: np.ndarray, label: np.ndarray, rounds: int = 400) -> LabelModel:
        """votes: patterns (n, voters) of 0 and 1; weight: documents of each; label: 0, 1 or -1 if unknown."""
        n, m = votes.shape
        known = label >= 0
        # Start: more voters than one speak for toxic; known labels hold.
        toxic = np.where(known, label, np.clip(votes.mean(axis=1) * 2, self.prior / 2, 0.95))
        self.parent = np.full(m, -1)
        for step in range(rounds):
            if step % 20 == 10:
                self.parent = self._tree(votes, weight, toxic)
            self._estimate(votes, weight, toxic)
            fresh = np.where(known, np.where(label == 1, 0.995, 0.005), self.posterior(votes))
            moved, toxic = np.abs(fresh - toxic).max(), fresh
            if step > 20 and moved < 1e-5:
                break
        self.accuracy = np.stack([self._share(votes, weight, 1 - toxic), self._share(votes, weight, toxic)], axis=1)
        self.correlation = self._correlations(votes, weight, toxic)
        return self

    @staticmethod
    def _share(votes, weight, belongs):
        w = weight * belongs
        return (w @ votes + 0.5) / (w.sum() + 1)

    def _joint(self, votes, weight, belongs, i, j):
        """P(vote i, vote j | class) as a 2 x 2 table."""
        w, table = weight * belongs, np.full((2, 2), 0.25)
        np.add.at(table, (votes[:, i], votes[:, j]), w)
        return table / table.sum()

    def _tree(self, votes, weight, toxic) -> np.ndarray:
        """Strongest dependencies given the class, as a forest (Prim), each voter pointing to its parent."""
        m = votes.shape[1]
        strength = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                for belongs in (1 - toxic, toxic):
                    t = self._joint(votes, weight, belongs, i, j)
                    free = np.outer(t.sum(axis=1), t.sum(axis=0))
                    strength[i, j] += (weight * belongs).sum() / weight.sum() * (t * np.log(t / free)).sum()
        strength += strength.T
        parent, inside = np.full(m, -1), {0}
        while len(inside) < m:
            value, i, j = max((strength[i, j], i, j) for i in range(m) if i not in inside for j in inside)
            parent[i] = j if value > 1e-5 else -1
            inside.add(i)
        return parent

    def _estimate(self, votes, weight, toxic) -> None:
        self.prior = float(np.clip((weight * toxic).sum() / weight.sum(), 1e-4, 0.9))
        self.tables = []
        for belongs in (1 - toxic, toxic):
            share = self._share(votes, weight, belongs)
            row = []
            for i, p in enumerate(self.parent):
                if p < 0:
                    row.append(np.array([[1 - share[i]] * 2, [share[i]] * 2]))
                else:
                    t = self._joint(votes, weight, belongs, i, p)
                    row.append(t / t.sum(axis=0))
            self.tables.append(row)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        score = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for k, row in enumerate(self.tables):
            for i, p in enumerate(self.parent):
                score[:, k] += np.log(row[i][votes[:, i], votes[:, p] if p >= 0 else 0])
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))

    def _correlations(self, votes, weight, toxic) -> np.ndarray:
        out = np.zeros(len(self.parent))
        for i, p in enumerate(self.parent):
            if p >= 0:
                for belongs in (1 - toxic, toxic):
                    t = self._joint(votes, weight, belongs, i, p)
                    a, b = t[1].sum(), t[:, 1].sum()
                    out[i] += (weight * belongs).sum() / weight.sum() * (t[1, 1] - a * b) / np.sqrt(a * (1 - a) * b * (1 - b))
        return out


def bits(votes: np.ndarray, count: int) -> np.ndarray:
    return (np.asarray(votes)[:, None] >> np.arange(count)) & 1


def fit_linear(active: list[list[int]], target: np.ndarray, features: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets: accelerated gradient steps, scaled per feature by its rows."""
    n = len(active)
    lengths = np.fromiter(map(len, active), np.int64, n)
    cols = np.fromiter((i for row in active for i in row), np.int64, int(lengths.sum()))
    rows = np.repeat(np.arange(n), lengths)
    curve = (lengths.max(initial=0) + 1) / 4  # bounds the second derivative, with the scaling below
    scale = curve * np.maximum(np.bincount(cols, minlength=features), 1.0)
    w, b = np.zeros(features), float(np.log(target.mean() + 1e-6) - np.log1p(1e-6 - target.mean()))
    ahead_w, ahead_b = w, b
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, ahead_w[cols], n) + ahead_b, -40, 40)))
        error = p - target
        next_w = ahead_w - np.bincount(cols, error[rows], features) / scale
        next_b = ahead_b - error.sum() / (curve * n)
        ahead_w, ahead_b = next_w + k / (k + 3) * (next_w - w), next_b + k / (k + 3) * (next_b - b)
        w, b = next_w, next_b
    return w, float(b)


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", limit: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic): at most `limit` different texts of at most `limit` labelled keys, both chosen by a hash.

    Keys are limited first, so that the labels fit a broadcast, and texts after the join, as a key may repeat.
    """
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64(key), key).limit(limit).select(F.col(key).alias("__key"), "toxic")
    rows = docs.select(F.col(key).alias("__key"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "__key")
    texts = rows.groupBy(F.xxhash64("text").alias("same"), "toxic").agg(F.first("text").alias("text"))
    # A limit leaves one partition; what is mined and fitted on it is spread again.
    return texts.orderBy("same", "toxic").limit(limit).select("text", "toxic").repartition(SAMPLE_TASKS, "text")


def score(
    docs: DataFrame, labels: DataFrame, keep: Iterable[str] = ("doc_id",), key: str = "doc_id", score_as: str = "score"
) -> DataFrame:
    """`keep` columns of every row of docs, the score (0 to 1) and with it `posterior`, the label model's own.

    labels (key, toxic): the rows labels may be learned from. Under another name than score, the
    posterior is left out. Column names of docs do not matter, but for the key and text.
    """
    keep, extra = list(keep), ("score", "posterior") if score_as == "score" else (score_as,)
    inner = [f"c{i}" for i in range(len(keep))]
    plain = docs.select(*[docs[c].alias(i) for c, i in zip(keep, inner)], docs[key].alias("key"), docs["text"].alias("text"))
    known = labels.select(labels[key].alias("key"), "toxic")
    made = _score(plain, known, inner)
    return made.select(*[F.col(i).alias(c) for c, i in zip(keep, inner)], *[F.col(s).alias(e) for s, e in zip(("score", "posterior"), extra)])


def _score(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    sample = scratch.store(training_sample(docs, labels, "key"), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    found, features = mine(sample, toxic, clean)
    lexicons = voters(found)
    count = len(lexicons) + 2
    voted = scratch.store(vote(docs, lexicons, features, keep), "votes")
    patterns = voted.groupBy("votes").count().collect()  # 2 ** count rows at most
    if not patterns:
        return voted.select(*keep, F.lit(0.0).alias("score"), F.lit(0.0).alias("posterior"))
    trained = vote(sample, lexicons, features, ["toxic"]).collect() if toxic and clean else []  # SAMPLE_ROWS rows

    known = Counter((r["votes"], r["toxic"]) for r in trained)
    every = [r["votes"] for r in patterns] + [v for v, _ in known]
    weight = np.array([r["count"] for r in patterns] + list(known.values()), float)
    label = np.array([-1] * len(patterns) + [y for _, y in known])
    model = LabelModel(count, toxic / (toxic + clean) if trained else 0.05).fit(bits(every, count), weight, label)
    posteriors = {int(r["votes"]): float(p) for r, p in zip(patterns, model.posterior(bits([r["votes"] for r in patterns], count)))}
    weights = None
    if trained:
        from_votes = model.posterior(bits([r["votes"] for r in trained], count))
        # A known label is a voter of fixed accuracy beside the others.
        odds = np.log(from_votes / (1 - from_votes)).clip(-12, 12) + np.array([6.0 if r["toxic"] else -6.0 for r in trained])
        weights = fit_linear([r["active"] for r in trained], 1 / (1 + np.exp(-odds)), len(features) + count)

    def run(**columns):
        votes, active = columns.pop("votes"), columns.pop("active")
        post = [posteriors[v] for v in votes]
        if weights is None:
            return columns | {"score": post, "posterior": post}
        w, b = weights
        sums = np.array([w[a].sum() if a else 0.0 for a in active]) + b
        return columns | {"score": 1 / (1 + np.exp(-sums.clip(-40, 40))), "posterior": post}

    kinds = "".join(f"`{c}` {voted.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(voted, run, f"{kinds}score double, posterior double")
