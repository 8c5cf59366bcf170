"""Toxic spans by a linear-chain conditional random field.

Labels say whether a document is toxic, not which words are.  Token labels
come from the labelled documents: a word or a word's beginning (3 to 8
letters) that stands in many different contexts in toxic documents and hardly
ever in clean ones marks its tokens as toxic there.  A feature counts in no more
toxic documents than it has contexts there, so that copies of one text do not
make its words suspicious.

A two-label chain (clean, toxic) is fitted to windows of such tokens; its
emissions are weights of the word and its beginnings.  Forward-backward over
every whole text gives each token's marginal.  The three highest marginals of
a text are turned into its score by a logistic curve fitted to the labels, and
runs of tokens with a marginal of one half or more are its offending spans.

Fitting uses at most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` labelled documents,
``FEATURES`` features and ``WINDOWS`` windows, drawn by hash; scoring reads all.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import plain, small_batches, stored

TOXIC_DOCS, CLEAN_DOCS = 6_000, 12_000
FEATURES, WINDOWS, WINDOW = 50_000, 8_000, 32
#: a feature is suspicious from this many contexts and this log ratio on
MIN_CONTEXTS, MIN_RATIO = 3, 1.8
THRESHOLD = 0.3
BLOCK = 64
_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word and its proper beginnings of 3 to 8 letters."""
    return [word, *(f"{word[:n]}~" for n in range(3, min(9, len(word))))]


def held_out(id_col: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    start: np.ndarray               # 2
    step: np.ndarray                # 2 x 2
    curve: np.ndarray               # constant and three marginals' weights

    def emission(self, word: str) -> float:
        w = self.weights
        return self.bias + sum(w.get(f, 0.0) for f in features(word))

    def score(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + top @ self.curve[1:])))


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Each token's probability of being toxic; ``first`` marks the first tokens
    of the texts that lie one after another.  Blocks of tokens are multiplied up
    side by side, then linked, then swept again with what enters them."""
    n = len(emission)
    if not n:
        return np.empty(0)
    blocks = -(-n // BLOCK)
    e = np.zeros(blocks * BLOCK)
    e[:n] = np.clip(emission, -30, 30)
    own = np.stack([np.ones_like(e), np.exp(e)], -1)                          # weights of the two labels
    own /= own.max(-1, keepdims=True)
    m = np.where(np.append(first, np.ones(len(e) - n, bool))[:, None, None], np.exp(start)[None, None, :], np.exp(step)[None])
    m = (m * own[:, None, :]).reshape(blocks, BLOCK, 2, 2)
    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2))
    for t in range(BLOCK):
        whole = whole @ m[:, t]
        whole = whole / whole.sum((1, 2), keepdims=True)
    enter, leave = np.empty((blocks, 2)), np.empty((blocks, 2))
    v = np.array([0.5, 0.5])
    for b in range(blocks):
        enter[b] = v
        v = v @ whole[b]
        v = v / v.sum()
    v = np.array([0.5, 0.5])
    for b in range(blocks - 1, -1, -1):
        leave[b] = v
        v = whole[b] @ v
        v = v / v.sum()
    ahead, back = np.empty((blocks, BLOCK, 2)), np.empty((blocks, BLOCK, 2))
    for t in range(BLOCK):
        enter = np.einsum("bi,bij->bj", enter, m[:, t])
        enter /= enter.sum(1, keepdims=True)
        ahead[:, t] = enter
    for t in range(BLOCK - 1, -1, -1):
        back[:, t] = leave
        leave = np.einsum("bij,bj->bi", m[:, t], leave)
        leave /= leave.sum(1, keepdims=True)
    both = (ahead * back).reshape(-1, 2)[:n]
    return both[:, 1] / both.sum(1)


def fit_chain(ids: np.ndarray, labels: np.ndarray, n_features: int, rounds: int = 200, decay: float = 1e-4) -> tuple:
    """Weights of a chain by gradient ascent on the labels' likelihood.  ``ids``:
    windows x tokens x feature numbers (``n_features`` stands for none);
    ``labels``: windows x tokens of 0, 1, or -1 after a window's end."""
    rows, length, _ = ids.shape
    there = labels >= 0
    gold = np.maximum(labels, 0)
    theta = np.zeros(n_features + 1 + 1 + 2 + 4)       # features, none, bias, start, step
    grad_m, grad_v = np.zeros_like(theta), np.zeros_like(theta)
    f = slice(0, n_features + 1)
    for k in range(1, rounds + 1):
        w, bias, start, step = theta[f], theta[-7], theta[-6:-4], theta[-4:].reshape(2, 2)
        e = np.clip(w[ids].sum(2) + bias, -30, 30)
        own = np.stack([np.ones_like(e), np.exp(e)], -1)
        own /= own.max(-1, keepdims=True)
        move = np.exp(step)
        ahead, back = np.empty((rows, length, 2)), np.ones((rows, length, 2))
        v = np.exp(start) * own[:, 0]
        ahead[:, 0] = v / v.sum(1, keepdims=True)
        for t in range(1, length):
            v = (ahead[:, t - 1] @ move) * own[:, t]
            ahead[:, t] = v / v.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            v = (own[:, t + 1] * back[:, t + 1]) @ move.T
            back[:, t] = np.where(there[:, t + 1, None], v / v.sum(1, keepdims=True), 1.0)
        p = ahead * back
        p /= p.sum(2, keepdims=True)
        pair = ahead[:, :-1, :, None] * move * (own * back)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        grad = np.zeros_like(theta)
        diff = np.where(there, gold - p[:, :, 1], 0.0)
        grad[f] = np.bincount(ids.ravel(), np.repeat(diff.ravel(), ids.shape[2]), n_features + 1)
        grad[n_features] = 0
        grad[-7] = diff.sum()
        head = there[:, 0]
        grad[-6:-4] = np.bincount(gold[head, 0], minlength=2) - p[head, 0].sum(0)
        both = there[:, 1:]
        seen = np.bincount((gold[:, :-1] * 2 + gold[:, 1:])[both], minlength=4)
        grad[-4:] = seen - pair[both].sum(0).ravel()
        grad = grad / rows - decay * theta
        grad_m = 0.9 * grad_m + 0.1 * grad
        grad_v = 0.999 * grad_v + 0.001 * grad**2
        theta += 0.1 * (grad_m / (1 - 0.9**k)) / (np.sqrt(grad_v / (1 - 0.999**k)) + 1e-8)
    return theta[f][:n_features], float(theta[-7]), theta[-6:-4], theta[-4:].reshape(2, 2)


def fit_curve(top: np.ndarray, label: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Logistic weights of a constant and the top marginals, by Newton steps."""
    x = np.column_stack([np.ones(len(top)), top])
    w = np.zeros(x.shape[1])
    rate = (label.sum() + 0.5) / (len(label) + 1)
    w[0] = np.log(rate / (1 - rate))
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        pull = decay * np.append(0, w[1:])
        curve = (x * (p * (1 - p))[:, None]).T @ x + decay * np.diag(np.append(1e-6, np.ones(len(w) - 1)))
        change = np.linalg.solve(curve, x.T @ (label - p) - pull)
        w += np.clip(change, -2, 2)
    w[1:] = np.maximum(w[1:], 0)                       # a higher marginal never lowers the score
    return w


class Scorer:
    """Applies a model to texts; lives in a worker."""

    def __init__(self, model: Model, remember: int = 300_000):
        self.model, self._known, self._remember = model, {}, remember

    def _emission(self, word: str) -> float:
        if len(self._known) >= self._remember:
            self._known.clear()
        self._known[word] = value = self.model.emission(word)
        return value

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        """The three highest marginals of each text, and its offending spans."""
        known, sizes, parts = self._known, [], []
        for text in texts:
            words = _WORD.findall(text.lower())
            sizes.append(len(words))
            parts.append(np.array([known[w] if w in known else self._emission(w) for w in words], np.float64))
        emission = np.concatenate(parts) if parts else np.empty(0)
        cuts = np.append(0, np.cumsum(sizes)).astype(np.int64)
        first = np.zeros(len(emission), bool)
        first[cuts[:-1][np.array(sizes, np.int64) > 0]] = True
        p = marginals(emission, first, self.model.start, self.model.step)
        top, spans = np.zeros((len(texts), 3)), []
        for i, text in enumerate(texts):
            own = p[cuts[i]:cuts[i + 1]]
            best = np.sort(np.partition(own, -3)[-3:] if len(own) > 3 else own)[::-1]
            top[i, :len(best)] = best
            spans.append(_spans(text, own) if len(best) and best[0] >= 0.5 else [])
        return top, spans


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of neighbouring tokens with a marginal of one half or more, as code
    point offsets with their highest marginal."""
    out: list[dict] = []
    last = -2
    low = text.lower()
    exact = len(low) == len(text)                      # a few characters change length in lower case
    for i, m in enumerate(_WORD.finditer(low if exact else text)):
        if i < len(p) and p[i] >= 0.5:
            if last == i - 1:
                out[-1]["end"], out[-1]["score"] = m.end(), max(out[-1]["score"], float(p[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "score": float(p[i])})
            last = i
    return out


def _suspicious(sample: DataFrame) -> dict[str, float]:
    """Log ratios of the features that mark toxic documents."""
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for text in batch.column("text").to_pylist():
                words = _WORD.findall(text.lower())
                pairs.update(zip(words, ["", *words[:-1]]))
            out = {(f, hash_of(before)) for word, before in pairs for f in features(word)}
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([c for _, c in out], pa.int64())],
                                             ["feature", "context"])

    toxic, clean = (sample.where(F.col("toxic") == t).select("text") for t in (1, 0))
    n_toxic, n_clean = toxic.count(), clean.count()
    wide = (toxic.mapInArrow(contexts, "feature string, context bigint").distinct().groupBy("feature")
            .agg(F.count("*").alias("contexts")).where(F.col("contexts") >= max(MIN_CONTEXTS, n_toxic // 500)))
    held = {r.feature: r.contexts for r in wide.orderBy(F.desc("contexts"), "feature").limit(4 * FEATURES).collect()}
    names = sample.sparkSession.sparkContext.broadcast(frozenset(held))

    def count_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = {f for w in set(_WORD.findall(text.lower())) for f in features(w)}
                count.update(found & names.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["feature", "n"])

    def in_docs(rows: DataFrame) -> dict[str, int]:
        found = rows.mapInArrow(count_docs, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
        return {r.feature: r.n for r in found.collect()}

    in_toxic, in_clean = in_docs(toxic), in_docs(clean)
    seen = {f: min(contexts, in_toxic.get(f, 0)) for f, contexts in held.items()}
    ratio = {f: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((in_clean.get(f, 0) + 0.5) / (n_clean + 1))) for f, n in seen.items()}
    return dict(sorted(((f, r) for f, r in ratio.items() if r > MIN_RATIO), key=lambda x: -seen[x[0]])[:FEATURES])


def hash_of(word: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word.encode()) >> 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows of ``docs`` that are not held out.

    ``labels``: the id column and ``toxic`` (null: no label; of several labels
    of one id the highest counts).  Without labels of both kinds the model
    gives every text the same score.  Null texts are empty.
    """
    small_batches(docs.sparkSession)
    known = (labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic")))
    order = F.xxhash64("id")
    drawn = (known.where("toxic = 1").orderBy(order, "id").limit(TOXIC_DOCS)
             .unionByName(known.where("toxic = 0").orderBy(order, "id").limit(CLEAN_DOCS)))
    texts = docs.select(plain(id_col).alias("id"), F.coalesce(plain(text_col), F.lit("")).alias("text"))
    # at most TOXIC_DOCS + CLEAN_DOCS ids: a broadcast of bounded size
    sample = stored(texts.join(F.broadcast(drawn), "id").select("id", "toxic", "text"), "toxicity-sample")
    ratio = _suspicious(sample)
    empty = Model({}, -10.0, np.array([0.0, -10.0]), np.array([[0.0, -10.0], [0.0, -10.0]]), np.zeros(4))
    if ratio:
        number = {f: i for i, f in enumerate(ratio)}
        shared = sample.sparkSession.sparkContext.broadcast(number)

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                out = defaultdict(list)
                for ident, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("id", "toxic", "text"))):
                    words = _WORD.findall(text.lower())
                    odd = [any(f in own for f in features(w)) for w in words]
                    hit = [bool(toxic) and h for h in odd]
                    rng = random.Random(ident)
                    places = [i for i, h in enumerate(odd) if h] or ([rng.randrange(len(words))] if words and not toxic else [])
                    for i in rng.sample(places, min(2, len(places))):
                        a = max(0, i - rng.randrange(WINDOW))
                        part = words[a:a + WINDOW]
                        out["order"].append(rng.getrandbits(62))
                        out["ids"].append([x for w in part for x in ([own.get(f, -1) for f in features(w)] + [-1] * 7)[:7]])
                        out["labels"].append([int(h) for h in hit[a:a + WINDOW]])
                yield pa.RecordBatch.from_arrays([pa.array(out["order"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int32())),
                                                  pa.array(out["labels"], pa.list_(pa.int32()))], ["order", "ids", "labels"])

        rows = sample.mapInArrow(windows, "order bigint, ids array<int>, labels array<int>").orderBy("order").limit(WINDOWS).collect()
        ids = np.full((len(rows), WINDOW, 7), len(number), np.int64)
        gold = np.full((len(rows), WINDOW), -1, np.int64)
        for i, r in enumerate(rows):
            n = len(r.labels)
            ids[i, :n] = np.array(r.ids, np.int64).reshape(n, 7)
            gold[i, :n] = r.labels
        ids[ids < 0] = len(number)
        weights, bias, start, step = fit_chain(ids, gold, len(number))
        empty = Model({f: float(weights[i]) for f, i in number.items() if weights[i]}, bias, start, step, np.zeros(4))
    tops = sample.select("toxic", "text").mapInArrow(_top_marginals(empty), "toxic int, a double, b double, c double").collect()
    if tops:
        empty.curve = fit_curve(np.array([[r.a, r.b, r.c] for r in tops]), np.array([r.toxic for r in tops], float))
    return empty


def _top_marginals(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            top, _ = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(top[:, k]) for k in range(3))], ["toxic", "a", "b", "c"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score, predicted (1 from ``threshold`` on), spans of every row, from
    its whole text alone; null or empty texts get the score of no marginal.
    Ids may be null or repeat; extra columns are ignored; no rows give none."""
    small_batches(docs.sparkSession, 500)
    rows = docs.select(plain(id_col).alias("id"), F.coalesce(plain(text_col), F.lit("")).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            top, spans = scorer(batch.column("text").to_pylist())
            value = model.score(top)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(spans, span)],
                ["id", "score", "predicted", "spans"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns of any type and name, that score
    below ``threshold``.  Null texts are empty; equal texts share their fate, so
    repeated rows stay or go together; no rows give none."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            top, _ = scorer([t or "" for t in batch.column("row").field(text_col).to_pylist()])
            yield batch.filter(pa.array(model.score(top) < threshold))

    rows = docs.select(F.struct(*map(plain, docs.columns)).alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
