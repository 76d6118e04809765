"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The labels mark documents. Words and word beginnings that stand almost only in toxic
documents label the tokens of a bounded sample; on these a field of two tags is trained, whose
chains are lines. It generalises over word beginnings and endings and over neighbours. Over the
whole corpus its forward-backward marginals give the toxic words, and a logistic curve over
them, fitted on the sampled documents, the score of each document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from onoma.llm.simhash import fingerprint

WORD = re.compile(r"[^\W\d_]+")
#: Tokens whose chains are computed together.
TOKENS_AT_ONCE = 500_000
STEP = 40.0


def features(word: str) -> list[str]:
    """Of a lower-cased word: itself, its beginnings and its ending."""
    n = len(word)
    return [f"={word}", *(f"{word[:k]}+" for k in (3, 4, 5, 6) if n > k), *([f"-{word[-3:]}"] if n > 3 else [])]


class Chains:
    """Lines of tokens, laid out step by step: all first tokens, all second ones, and so on."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)
        at = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.empty(0, np.int64)
        line = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        self.widths = np.bincount(at, minlength=1) if len(at) else np.empty(0, np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.widths)))
        self.place = self.offsets[at] + rank[line]
        self.first = at == 0
        self.ends = ends

    def marginals(self, emission: np.ndarray, start: float, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each token, and the expected number of each change of tags, [from, to]."""
        e = np.empty(len(emission))
        e[self.place] = np.exp(np.clip(emission, -STEP, STEP))
        a = np.exp(change)
        ahead, back = np.empty(len(e)), np.empty(len(e))  # ratios toxic : clean
        for t, (lo, n) in enumerate(zip(self.offsets[:-1], self.widths, strict=True)):
            if t == 0:
                ahead[:n] = e[:n] * np.exp(start)
            else:
                r = ahead[last : last + n]
                ahead[lo : lo + n] = e[lo : lo + n] * (r * a[1, 1] + a[0, 1]) / (r * a[1, 0] + a[0, 0])
            last = lo
        pairs = np.zeros((2, 2))
        for t in range(len(self.widths) - 1, -1, -1):
            lo, n = self.offsets[t], self.widths[t]
            m = self.widths[t + 1] if t + 1 < len(self.widths) else 0
            back[lo + m : lo + n] = 1.0
            if m:
                hi = self.offsets[t + 1]
                x = e[hi : hi + m] * back[hi : hi + m]
                to_clean, to_toxic = a[0, 0] + a[0, 1] * x, a[1, 0] + a[1, 1] * x
                back[lo : lo + m] = to_toxic / to_clean
                r = ahead[lo : lo + m]
                whole = to_clean + r * to_toxic
                pairs += [[(a[0, 0] / whole).sum(), (a[0, 1] * x / whole).sum()], [(r * a[1, 0] / whole).sum(), (r * a[1, 1] * x / whole).sum()]]
        odds = ahead * back
        return (odds / (1 + odds))[self.place], pairs


@dataclass(frozen=True)
class Toxicity:
    """A trained field, and the curve from marginals to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -STEP
    start: float = 0.0
    change: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def tag(self, lines: list[list[str]], known: dict[str, float] | None = None) -> np.ndarray:
        """P(toxic) of the words of all lines, in order."""
        known = {} if known is None else known
        if len(known) > 1_000_000:
            known.clear()
        words = [w for x in lines for w in x]
        for w in set(words) - known.keys():
            known[w] = self.emission(w)
        lengths = np.fromiter((len(x) for x in lines if x), np.int64)
        e = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        return Chains(lengths).marginals(e, self.start, np.array(self.change))[0] if len(words) else e

    def score(self, top: np.ndarray, mass: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * top + b * np.log1p(mass) + c, -STEP, STEP)))


def lines_of(text: str) -> list[list[str]]:
    return [WORD.findall(x) for x in text.lower().split("\n")]


def summary(p: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each document of so many tokens: the greatest marginal, and the mass of those from a half on."""
    at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    top, mass = np.zeros(len(lengths)), np.zeros(len(lengths))
    some = np.flatnonzero(np.diff(at))
    if len(some):
        top[some] = np.maximum.reduceat(p, at[some])
        mass[some] = np.add.reduceat(np.where(p >= 0.5, p, 0), at[some])
    return top, mass


def distinct_texts(texts: list[str], radius: int = 6) -> list[int]:
    """Indices of texts that are no near copies of earlier ones: copies would make their words look like markers."""
    kept: list[int] = []
    prints = np.empty(len(texts), dtype=np.uint64)
    for i, t in enumerate(texts):
        f = np.uint64(fingerprint(t.encode()))
        if not (np.bitwise_count(prints[: len(kept)] ^ f) <= radius).any():
            prints[len(kept)] = f
            kept.append(i)
    return kept


def markers(docs: list[list[list[str]]], toxic: np.ndarray, min_ratio: float = 20.0, stem_ratio: float = 6.0, min_evidence: float = 14.0) -> set[str]:
    """Features that are min_ratio times as frequent among toxic documents, by more than chance.

    For beginnings of five letters and more stem_ratio is enough: clean words may share a stem of
    toxic ones. Chance is the bound exp(-n KL(share || mean)) on n documents with the feature having so high
    a share of toxic ones; e^-14 is below one in a million, for vocabularies of that order.
    """
    seen = (Counter(), Counter())
    for x, y in zip(docs, toxic, strict=True):
        seen[int(y)].update({f for line in x for w in line for f in features(w)})
    n, mean = [int((toxic == y).sum()) for y in (0, 1)], float(toxic.mean())

    def evidence(c1: int, c0: int) -> float:
        q = c1 / (c1 + c0)
        return (c1 + c0) * ((q * np.log(q / mean)) + ((1 - q) * np.log((1 - q) / (1 - mean)) if c0 else 0.0))

    def ratio(f: str) -> float:
        return stem_ratio if f[-1] == "+" and len(f) > 5 else min_ratio

    return {f for f, c in seen[1].items() if c / n[1] >= ratio(f) * (seen[0][f] + 0.5) / n[0] and evidence(c, seen[0][f]) >= min_evidence}


def train(texts: list[str], toxic: list[int], prevalence: float | None = None, rounds: int = 60, rate: float = 0.3, decay: float = 0.02) -> Toxicity:
    """The field and curve of labelled texts; without both labels, a constant score that is their mean.

    prevalence is the share of toxic texts where the sample comes from, if classes were sampled apart.
    """
    kept = distinct_texts(texts)
    texts, y = [texts[i] for i in kept], np.array([toxic[i] for i in kept], dtype=np.int64)
    mean = float(y.mean()) if len(y) else 0.0
    flat = Toxicity(curve=(0.0, 0.0, float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))))
    if not 0 < y.sum() < len(y):
        return flat
    docs = [lines_of(t) for t in texts]
    marked = markers(docs, y)
    if not marked:
        return flat
    lines = [(x, t) for d, t in zip(docs, y, strict=True) for x in d if x]
    words = [w for x, _ in lines for w in x]
    names: dict[str, int] = {}
    kinds: dict[str, int] = {}
    own: list[list[int]] = []
    hit: list[bool] = []
    for w in words:
        if w not in kinds:
            kinds[w] = len(kinds)
            f = features(w)
            own.append([names.setdefault(x, len(names)) for x in f])
            hit.append(any(x in marked for x in f))
    kind = np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))
    lengths = np.array([len(x) for x, _ in lines])
    gold = np.array(hit)[kind] & (np.repeat([t for _, t in lines], lengths) == 1)
    chains = Chains(lengths)
    flat_features = np.concatenate([np.array(x) for x in own])
    owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
    inner = ~chains.first
    seen = np.zeros((2, 2))
    before = np.concatenate(([False], gold[:-1]))
    np.add.at(seen, (before[inner].astype(int), gold[inner].astype(int)), 1)
    gold_kind = np.bincount(kind, gold, len(own))
    size = len(names) + 6  # features, bias, start, changes
    theta, sums, moved = np.zeros(size), np.zeros(size), np.zeros(size)
    theta[len(names)] = -3.0
    for _ in range(rounds):
        w, bias, start, change = theta[: len(names)], theta[len(names)], theta[len(names) + 1], theta[len(names) + 2 :].reshape(2, 2)
        scores = bias + np.bincount(owner, w[flat_features], len(own))
        p, pairs = chains.marginals(scores[kind], start, change)
        miss = gold_kind - np.bincount(kind, p, len(own))
        grad = np.concatenate((np.bincount(flat_features, miss[owner], len(names)), [miss.sum(), (gold - p)[chains.first].sum()], (seen - pairs).ravel()))
        grad -= decay * np.concatenate((w, np.zeros(6)))
        moved = 0.8 * moved + 0.2 * grad
        sums = 0.9 * sums + 0.1 * grad**2
        theta = theta + rate * moved / (np.sqrt(sums) + 1e-6)
    weights = {f: round(float(theta[i]), 4) for f, i in names.items() if abs(theta[i]) > 0.05}
    model = Toxicity(weights, float(theta[len(names)]), float(theta[len(names) + 1]), tuple(map(tuple, theta[len(names) + 2 :].reshape(2, 2).tolist())))
    parts = [summary(model.tag(d), [sum(map(len, d))]) for d in docs]
    x = np.stack([np.array([float(t[0]) for t, _ in parts]), np.log1p([float(m[0]) for _, m in parts]), np.ones(len(docs))], axis=1)
    c = np.array([1.0, 1.0, -2.0])
    for _ in range(25):  # Newton's steps, with a little decay for separable samples
        q = 1 / (1 + np.exp(-np.clip(x @ c, -STEP, STEP)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        c = c + np.linalg.solve(h, x.T @ (y - q) - 0.05 * c)
    if prevalence and prevalence < 1:  # the sample's odds are taken off the curve, and the true ones put on
        c[2] += np.log(prevalence / (1 - prevalence)) - np.log(y.mean() / (1 - y.mean()))
    return Toxicity(model.weights, model.bias, model.start, model.change, tuple(map(float, c)))


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int) -> tuple[list[str], list[int], float | None]:
    """At most max_docs labelled texts of each class, by hash order, none of them held out; and the share of toxic labels.

    Texts over max_chars are left to others, so that the driver holds 2 x max_docs x max_chars at most.
    """
    marks = labels.select(F.col("doc_id").alias("_d"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    marks = marks.groupBy("_d").agg(F.max("toxic").alias("toxic")).filter(F.crc32(F.col("_d").cast("string")) % 3 != 1)
    # twice the bound by hash, so that few texts meet the labels, in one pass for both classes; these are cut after the join
    order = [F.xxhash64("_d"), F.col("_d")]
    ids = [marks.filter(F.col("toxic") == y).orderBy(*order).limit(2 * max_docs) for y in (0, 1)]
    met = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), F.col("doc_id") == F.col("_d")).filter(F.length("text") <= max_chars)
    ranked = met.groupBy("_d", "toxic").agg(F.min("text").alias("text")).withColumn("_n", F.row_number().over(Window.partitionBy("toxic").orderBy(*order)))
    rows = ranked.filter(F.col("_n") <= max_docs).orderBy("toxic", "_n").select("text", "toxic").collect()
    texts, toxic = [r.text for r in rows], [r.toxic for r in rows]
    share = marks.agg(F.avg("toxic")).first()[0]
    return texts, toxic, share


def _spans(text: str, p: np.ndarray, limit: float) -> list[dict[str, int]]:
    """Code points of the words whose marginal is over the limit; words are found line by line in the text as it is."""
    out, i, at = [], 0, 0
    for line in text.split("\n"):
        lowered = line.lower()
        words = [m.span() for m in WORD.finditer(lowered)]
        if len(lowered) != len(line):  # a few letters change their length; then offsets are those of the words as found in the raw line
            raw = [m.span() for m in WORD.finditer(line)]
            words = raw if len(raw) == len(words) else words
        out += [{"start": at + a, "end": at + b} for (a, b), q in zip(words, p[i : i + len(words)], strict=True) if q >= limit]
        i += len(words)
        at += len(line) + 1
    return out


def _scored(model: Toxicity, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = b.column("doc_id")
            lo = 0
            while lo < len(texts):
                docs, n, hi = [], 0, lo
                while hi < len(texts) and (n < TOKENS_AT_ONCE or hi == lo):
                    docs.append(lines_of(texts[hi]))
                    n += sum(map(len, docs[-1]))
                    hi += 1
                p = model.tag([x for d in docs for x in d], known)
                lengths = [sum(map(len, d)) for d in docs]
                top, mass = summary(p, lengths)
                ends = np.cumsum(lengths)
                spans = [_spans(t, p[e - k : e], limit) if m >= limit else [] for t, e, k, m in zip(texts[lo:hi], ends, lengths, top, strict=True)]
                held = [is_held_out(x) for x in ids.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(held), pa.array(model.score(top, mass)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "held_out", "score", "spans"])
                lo = hi

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_chars: int = 20_000, limit: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, spans) for each row of docs(doc_id, text, ...).

    The field is fitted on at most max_docs labelled documents of each class of up to max_chars code points,
    and tags every whole text in one pass without a shuffle. Null and wordless texts get the score of
    no toxic word. Without labels of both classes the score is the mean label. A null doc_id is not held out.
    Rows that repeat a doc_id are each scored by their own text; an empty table gives no rows. Other columns
    are not read, whatever their names. A very long text is tagged line by line, from end to end.
    """
    model = train(*sample(docs, labels, max_docs, max_chars))
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("score", "double")
    read = docs.select("doc_id", "text")
    return read.mapInArrow(_scored(model, limit), schema.add("spans", ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))))
