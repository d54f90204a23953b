"""Toxicity scores from weak supervision.

Voters are words of a lexicon, words and word beginnings that the labelled training rows show to
be telling, and patterns (density of such words, insults after a form of address, shouting). A
generative model of their votes is fitted by expectation maximisation: each voter has its own
chance of each vote in toxic and in clean documents, and voters that go together within a class
(their conditional correlation) share one say instead of each having a full one. Its posterior
labels train a logistic model over the same words' counts, which scores every document.

The sample that the models are fitted on is bounded: at most `most_rows` labelled documents, by
hash of their ids. Scores are computed for all rows, from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltamesh.llm.common import bucket_crc, cut
from deltamesh.llm.textarrays import Lookup, Slice, TO_LOWER, hashes, runs, slices_of

#: Common insults, as plain words.
LEXICON = (
    "idiot idiots moron morons stupid trash scum loser losers clown clowns pathetic worthless disgusting "
    "imbecile fool fools dumb dumbass jerk pig vermin garbage filth filthy parasite scumbag bastard bitch "
    "asshole shit crap fuck fucking retard ugly hate kill die "
    "connard connasse salope merde ordure débile abruti crétin imbécile stupide dégueulasse minable "
    "arschloch scheiße scheisse dummkopf trottel abschaum widerlich wertlos erbärmlich dreck "
    "idiota estúpido estúpida imbécil basura escoria payaso perdedor asqueroso inútil patético mierda pendejo cabrón"
).split()
#: Forms of address before which an insult is a stronger sign.
ADDRESS = "you your you're u du dein deine sie tu ton ta vous votre tú usted eres".split()
#: Word beginnings, in bytes, looked at beside whole words.
STEMS = (5, 6, 7, 8)
MOST_ROWS, MOST_TERMS, CANDIDATES = 12_000, 384, 20_000
THRESHOLD = 0.7
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LETTER[0x27] = True


def _key(word: bytes) -> int:
    buffer = np.frombuffer(word + bytes(8), np.uint8)
    return int(hashes(buffer, np.array([0]), np.array([len(word)]))[0])


def letters(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a slice, and the starts and ends of its runs of letters."""
    data = TO_LOWER[s.data]
    lead = np.flatnonzero(s.body == 0xC3)
    if lead.size:
        follow = data[lead + 1]
        data[lead[(follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97)] + 1] += 0x20
    return data, *runs(_LETTER[s.body], s.bounds)


def terms_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices of words, term hashes): whole words, then the beginnings of longer words."""
    yield np.arange(len(starts)), hashes(data, starts, ends)
    for k in STEMS:
        long = np.flatnonzero(ends - starts > k)
        yield long, hashes(data, starts[long], starts[long] + k) ^ np.uint64(0xA5A5A5A500000000 + k)


@dataclass
class Counter:
    """Counts of known terms, and the pattern measurements, per document."""

    keys: np.ndarray

    def __post_init__(self):
        self.look = Lookup(self.keys)
        self.lexicon = Lookup(np.sort(np.array([_key(w.encode()) for w in set(LEXICON)], np.uint64)))
        self.address = Lookup(np.sort(np.array([_key(w.encode()) for w in set(ADDRESS)], np.uint64)))

    def __call__(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Counts (document x term), and (words, lexicon hits, hits after an address, upper-case share in %)."""
        data, starts, ends = letters(s)
        doc = np.searchsorted(s.bounds, starts, "right") - 1
        k = max(1, len(self.keys))
        count = np.zeros(s.n * k)
        other = np.zeros((s.n, 4))
        for words, h in terms_of(data, starts, ends):
            at = self.look(h)
            hit = at >= 0
            count += np.bincount(doc[words[hit]] * k + at[hit], minlength=s.n * k)
            if len(words) == len(starts) and not other[:, 0].any():
                other[:, 0] = np.bincount(doc, minlength=s.n)
                bad = self.lexicon(h) >= 0
                other[:, 1] = np.bincount(doc[bad], minlength=s.n)
                near = np.zeros(len(h), bool)
                for step in (1, 2, 3):
                    near[step:] |= (self.address(h[:-step]) >= 0) & (doc[step:] == doc[:-step])
                other[:, 2] = np.bincount(doc[bad & near], minlength=s.n)
        upper = np.concatenate([[0], np.cumsum((s.body >= 65) & (s.body <= 90))])
        lower = np.concatenate([[0], np.cumsum((s.body >= 97) & (s.body <= 122))])
        u, low = upper[s.bounds[1:]] - upper[s.bounds[:-1]], lower[s.bounds[1:]] - lower[s.bounds[:-1]]
        other[:, 3] = 100 * u / np.maximum(u + low, 1)
        return count.reshape(s.n, k), other


def features(count: np.ndarray, other: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Inputs of the linear model. weight: how telling each term is, 0 to 1."""
    hits = count @ weight
    words = np.maximum(other[:, 0], 1)
    extra = np.stack([np.log1p(hits), np.minimum(100 * hits / words, 20) / 5, np.log1p(other[:, 1]), np.minimum(100 * other[:, 1] / words, 20) / 5, np.log1p(other[:, 2]), hits >= 2, hits >= 1, other[:, 3] >= 60], 1)
    return np.concatenate([np.log1p(count) * weight, extra], 1)


def votes_of(count: np.ndarray, other: np.ndarray, voters: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Votes (document x voter): 1 toxic, -1 clean, 0 none."""
    hits = count @ weight
    rate = 100 * hits / np.maximum(other[:, 0], 1)
    columns = [np.where(count[:, v].sum(1) > 0, 1, 0) for v in voters]
    columns += [
        np.where(hits >= 3, 1, np.where(hits < 1, -1, 0)),
        np.where(rate >= 1.0, 1, np.where(rate < 0.2, -1, 0)),
        np.where(other[:, 1] >= 2, 1, 0),
        np.where(other[:, 2] >= 1, 1, 0),
        np.where((other[:, 3] >= 60) & (other[:, 1] >= 1), 1, 0),
        np.where((count > 0).sum(1) >= 2, 1, np.where((count > 0).sum(1) == 0, -1, 0)),
    ]
    return np.stack(columns, 1).astype(np.int8)


@dataclass
class LabelModel:
    """Chances of each vote (-1, 0, 1) by class, the class balance, and each voter's share of a say."""

    prior: float
    chance: np.ndarray  # voter x class x vote
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        index = votes.astype(np.int64) + 1
        log = np.log(self.chance)
        say = sum(self.share[j] * (log[j, 1, index[:, j]] - log[j, 0, index[:, j]]) for j in range(votes.shape[1]))
        z = np.clip(say + np.log(self.prior / (1 - self.prior)), -40, 40)
        return 1 / (1 + np.exp(-z))

    def accuracies(self) -> np.ndarray:
        """Chance that a voter which votes is right."""
        right = self.prior * self.chance[:, 1, 2] + (1 - self.prior) * self.chance[:, 0, 0]
        voted = self.prior * (1 - self.chance[:, 1, 1]) + (1 - self.prior) * (1 - self.chance[:, 0, 1])
        return right / np.maximum(voted, 1e-12)


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """Expectation maximisation from the share of toxic among the votes, with the class balance held at `prior`."""
    n, m = votes.shape
    toxic, clean = (votes == 1).sum(1), (votes == -1).sum(1)
    p = np.clip((toxic + prior) / (toxic + clean + 1), 0.01, 0.99)
    model = LabelModel(prior, np.full((m, 2, 3), 1 / 3), np.ones(m))
    for _ in range(rounds):
        weight = np.stack([1 - p, p])
        for v in (-1, 0, 1):
            model.chance[:, :, v + 1] = ((votes == v).T @ weight.T + 0.1) / (weight.sum(1) + 0.3)
        # correlation within the classes: residuals of the votes against what each class expects
        cov = np.zeros((m, m))
        for y in (0, 1):
            mean = model.chance[:, y, 2] - model.chance[:, y, 0]
            r = (votes - mean) * np.sqrt(weight[y])[:, None]
            cov += r.T @ r / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 1)
        model.share = 1 / np.where(corr > 0.1, corr, 0).sum(1)
        new = model.posterior(votes)
        done = np.abs(new - p).max() < 1e-4
        p = new
        if done:
            break
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, for soft labels y; Newton steps with a ridge on the weights."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 10 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Scorer:
    keys: np.ndarray
    weight: np.ndarray
    linear: np.ndarray

    def scores(self, s: Slice, count_terms: Counter) -> np.ndarray:
        count, other = count_terms(s)
        if not len(self.keys):
            count = np.zeros((s.n, 0))
        x = features(count, other, self.weight)
        return 1 / (1 + np.exp(-np.clip(x @ self.linear[:-1] + self.linear[-1], -30, 30)))


def untrained() -> Scorer:
    """Without labelled toxic rows: the lexicon alone, fixed weights on its count and density."""
    linear = np.zeros(9)
    linear[2], linear[3], linear[4], linear[-1] = 2.0, 1.0, 1.0, -3.5
    return Scorer(np.zeros(0, np.uint64), np.zeros(0), linear)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Scorer:
    """Fit on labelled rows whose crc32(id) mod 3 is not 1. docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(bucket_crc("doc_id", 3) != 1)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # at most most_rows ids of eight bytes: small enough to send to every executor
    sample = cut(docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxic-sample")
    n_toxic = sample.where("toxic = 1").count()
    if n_toxic == 0:
        return untrained()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices_of(batch.column(0)):
                data, starts, ends = letters(s)
                doc = np.searchsorted(s.bounds, starts, "right") - 1
                pairs = np.concatenate([np.stack([h, doc[words].astype(np.uint64)]) for words, h in terms_of(data, starts, ends)], 1)
                order = np.lexsort(pairs)
                pairs = pairs[:, order]
                new = np.r_[True, (np.diff(pairs[0]) != 0) | (np.diff(pairs[1]) != 0)] if pairs.shape[1] else np.zeros(0, bool)
                h, n = np.unique(pairs[0][new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    least = max(3, n_toxic // 200)
    terms = sample.where("toxic = 1").select("text").mapInArrow(met, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = terms.orderBy(F.col("n").desc(), "h").limit(CANDIDATES).select("h").toArrow()
    candidates = np.sort(np.asarray(top["h"].combine_chunks()).view(np.uint64))
    sent = spark.sparkContext.broadcast(candidates)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_terms = Counter(sent.value)
        look = count_terms.look
        for batch in batches:
            toxic = np.asarray(batch.column(0))
            for s in slices_of(batch.column(1), 200_000):
                data, starts, ends = letters(s)
                doc = np.searchsorted(s.bounds, starts, "right") - 1
                at, own = [], []
                for words, h in terms_of(data, starts, ends):
                    i = look(h)
                    at.append(i[i >= 0])
                    own.append(doc[words[i >= 0]])
                at, own = np.concatenate(at), np.concatenate(own)
                key, n = np.unique(own * len(candidates) + at, return_counts=True)
                _, other = Counter(np.zeros(0, np.uint64))(s)
                offsets = pa.array(np.searchsorted(key, np.arange(s.n + 1) * len(candidates)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % max(1, len(candidates)), n)]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[s.first : s.first + s.n]), *lists, *(pa.array(other[:, k]) for k in range(4))], ["toxic", "at", "n", "o0", "o1", "o2", "o3"])

    t = sample.mapInArrow(counted, "toxic int, at array<int>, n array<int>, o0 double, o1 double, o2 double, o3 double").toArrow()
    toxic = np.asarray(t["toxic"].combine_chunks())
    at = t["at"].combine_chunks()
    n_of = np.asarray(t["n"].combine_chunks().flatten())
    row = np.repeat(np.arange(len(toxic)), np.diff(np.asarray(at.offsets)))
    term = np.asarray(at.flatten())
    other = np.stack([np.asarray(t[f"o{k}"].combine_chunks()) for k in range(4)], 1)

    # telling terms: mostly met in toxic rows, by a margin that chance doesn't give
    k = len(candidates)
    a, b = np.bincount(term[toxic[row] == 1], minlength=k), np.bincount(term[toxic[row] == 0], minlength=k)
    base = toxic.mean()
    purity = (a + 0.5 * base) / (a + b + 0.5)
    z = (a - (a + b) * base) / np.sqrt(np.maximum((a + b) * base * (1 - base), 1e-9))
    known = Lookup(np.sort(np.array([_key(w.encode()) for w in set(LEXICON)], np.uint64)))(candidates) >= 0
    telling = np.flatnonzero((purity >= np.where(known, 0.3, 0.6)) & (z >= 4))
    telling = np.sort(telling[np.argsort(-z[telling], kind="stable")][:MOST_TERMS])
    if not len(telling):
        return untrained()
    keys, weight = candidates[telling], purity[telling]
    place = np.full(k, -1)
    place[telling] = np.arange(len(telling))
    count = np.zeros((len(toxic), len(telling)))
    use = place[term] >= 0
    count[row[use], place[term[use]]] = n_of[use]

    # voters: the most telling terms alone, and the rest in groups of alike purity
    by = np.argsort(-z[telling], kind="stable")
    voters = [np.array([i]) for i in by[:40]] + [g for g in np.array_split(by[40:], 12) if len(g)]
    votes = votes_of(count, other, voters, weight)
    model = fit_label_model(votes, float(np.clip(base, 0.01, 0.5)))
    y = model.posterior(votes)
    x = features(count, other, weight)
    linear = fit_logistic(x, y)
    # the posterior orders documents; the labelled rows say what a score means
    z = x @ linear[:-1] + linear[-1]
    slope, shift = fit_logistic(z[:, None], toxic.astype(float), ridge=1e-3)
    return Scorer(keys, weight, np.r_[linear[:-1] * slope, linear[-1] * slope + shift] if slope > 0 else linear)


def score_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each input row.

    held_out: crc32 of the id's text modulo 3 is 1. Null texts score as empty ones; null ids count
    as the empty text. Labels that are null or neither 0 nor 1 are not learned from; of several
    labels for one id the highest counts. Without usable toxic labels the lexicon alone decides.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(source, labels, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        count_terms = Counter(scorer.keys)
        for batch in batches:
            for s in slices_of(batch.column(1), 3_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(scorer.scores(s, count_terms))], ["doc_id", "score"])

    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (bucket_crc("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_rows: int = MOST_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; one map, nothing is joined."""
    trained = train(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), labels, most_rows)
    sent = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        count_terms = Counter(scorer.keys)
        for batch in batches:
            for s in slices_of(batch.column(text_col), 3_000_000):
                yield batch.slice(s.first, s.n).filter(pa.array(scorer.scores(s, count_terms) < threshold))

    return docs.mapInArrow(run, docs.schema)
