"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or.

A document is a bag of sentences.  A sentence scores p = sigmoid(b + sum of w over its word
features); the document scores 1 - prod(1 - p).  Only documents are labelled, so w and b are
fitted on the documents' likelihood; the sentence scores then say where the offence stands.

Features: hashes of each lower-cased word and of its first 4 to 7 bytes, so that inflected forms
share evidence.  The model is fitted in one task on a bounded sample of labelled rows (at most
SAMPLE_POSITIVE + SAMPLE_NEGATIVE, by a hash of the id; class weights restore the class shares)
and keeps features that at least MIN_DOCS sampled texts have and that lean to label 1.  Scoring is
one map over whole texts; only the sampled ids and the weights are broadcast.

Defined cases: null text counts as empty and scores as one sentence without words; ids with
several labels count once a label row; without labelled rows of both kinds every score is the
share of label 1 (0 if none); repeated rows are scored alike; extra columns pass through, and a
result column replaces an input column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm import vec
from newsprism.llm.columns import Columns, arrow_schema, batch_of, boxed_schema

SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 4000, 6000
MIN_DOCS = 3
BITS = 20
PREFIXES = (4, 5, 6, 7)
STEPS, RATE, RIDGE = 250, 0.25, 0.02
CUT = 0.3
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".!?\n"]] = True


def features(w: vec.Words) -> np.ndarray:
    """Feature numbers of each word: whole word, then prefixes (-1 where the word is shorter)."""
    size = w.ends - w.starts
    out = np.full((w.n, 1 + len(PREFIXES)), -1, np.int32)
    if not w.n:
        return out
    shift = np.uint64(64 - BITS)
    out[:, 0] = (w.hashes() >> shift).astype(np.int32)
    padded = np.concatenate([w.buf, np.zeros(8, np.uint8)])
    lane = np.ndarray((len(w.buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))[w.starts]
    for k, n in enumerate(PREFIXES, 1):
        long = size >= n
        h = vec.mix((lane[long] & np.uint64((1 << (8 * n)) - 1)) ^ np.uint64(n << 60))
        out[long, k] = (h >> shift).astype(np.int32)
    return out


def sentences(w: vec.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence of each word, text of each sentence, first byte of each sentence (in the chunk)."""
    ends = _SENTENCE[w.buf] & ~np.concatenate([_SENTENCE[w.buf[1:]], [False]])
    bounds = np.union1d(np.flatnonzero(ends) + 1, w.begin[:-1])
    of_word = np.searchsorted(bounds, w.starts, "right") - 1
    used = np.unique(of_word)
    text_of = np.searchsorted(w.begin, bounds[used], "right") - 1
    return np.searchsorted(used, of_word), text_of, bounds[used]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray | float) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -z))


def fit(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, their weights, and the bias.  Adam on the weighted likelihood."""
    share = float((weight * toxic).sum() / weight.sum()) if len(toxic) else 0.0
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    none = np.empty(0, np.int32), np.empty(0), bias if len(toxic) else -30.0
    if not len(toxic) or toxic.min() == toxic.max():
        return none
    df = np.zeros((2, 1 << BITS), np.int32)
    parts, n_sent, owner = [], 0, []
    for i, j in vec.chunks(texts):
        w = vec.Words(texts[i:j], vec.NON_ALNUM, fold=True)
        f = features(w)
        of_word, text_of, _ = sentences(w)
        text = np.repeat(np.arange(i, j), w.counts())
        flat, t, s = f.ravel(), np.repeat(text, f.shape[1]), np.repeat(of_word + n_sent, f.shape[1])
        ok = flat >= 0
        flat, t, s = flat[ok], t[ok], s[ok]
        pair = np.unique(t.astype(np.int64) << BITS | flat)
        np.add.at(df, (toxic[pair >> BITS].astype(int), pair & ((1 << BITS) - 1)), 1)
        parts.append((flat, s))
        owner.append(text_of + i)
        n_sent += len(text_of)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    lean = (df[1] + 0.5) / (n1 + 1) > 2 * (df[0] + 0.5) / (n0 + 1)
    chosen = np.flatnonzero((df.sum(0) >= MIN_DOCS) & (df[1] >= 2) & lean).astype(np.int32)
    if not len(chosen):
        return none
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    feat = np.concatenate([place[f] for f, _ in parts])
    sent = np.concatenate([s for _, s in parts])[feat >= 0]
    feat = feat[feat >= 0]
    doc = np.concatenate(owner)
    # sentences without chosen features score alike: keep their number a document
    used, sent = np.unique(sent, return_inverse=True)
    plain = np.bincount(doc, minlength=len(texts)) - np.bincount(doc[used], minlength=len(texts))
    plain = np.maximum(plain, (np.bincount(doc, minlength=len(texts)) == 0).astype(int))
    doc = doc[used]
    # documents with several sentences spread their share over them
    bias -= float(np.log(max(1.0, n_sent / len(texts))))
    x = np.append(np.zeros(len(chosen)), bias)
    m, v = np.zeros_like(x), np.zeros_like(x)
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        z = x[-1] + np.bincount(sent, x[feat], len(used))
        nothing = np.bincount(doc, _softplus(z), len(texts)) + plain * _softplus(x[-1])  # -log(1 - P)
        pull = np.where(toxic == 1, -1 / np.maximum(np.expm1(np.minimum(nothing, 700)), 1e-9), 1.0) * weight
        p, p0 = _sigmoid(z), _sigmoid(x[-1])
        g_sent = p * pull[doc]
        g = np.append(np.bincount(feat, g_sent[sent], len(chosen)), g_sent.sum() + p0 * (pull * plain).sum())
        g[:-1] += RIDGE / len(texts) * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) / (1 + step / 60)
    return chosen, x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits the model on labels (doc_id, toxic) whose rows satisfy `learn`."""
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(learn) if learn is not None else known
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_POSITIVE).unionByName(known.where("toxic = 0").orderBy(*order).limit(SAMPLE_NEGATIVE))
    cuts = {1: SAMPLE_POSITIVE, 0: SAMPLE_NEGATIVE}
    weights = {k: max(1.0, n / cuts[k]) for k, n in total.items()}
    # at most SAMPLE_POSITIVE + SAMPLE_NEGATIVE ids
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def learn_all(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
        toxic = table["toxic"].to_numpy()
        f, w, b = fit(vec.utf8(table["text"]), toxic, np.array([weights.get(int(t), 1.0) for t in toxic]))
        return pa.table({"feature": pa.array(np.append(f, -1), pa.int32()), "weight": pa.array(np.append(w, b), pa.float64())})

    rows = picked.groupBy(F.lit(0).alias("all")).applyInArrow(learn_all, "feature int, weight double").collect()
    if not rows:
        return np.empty(0, np.int32), np.empty(0), -30.0
    return np.array([r.feature for r in rows if r.feature >= 0], np.int32), np.array([r.weight for r in rows if r.feature >= 0]), next(r.weight for r in rows if r.feature < 0)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of `docs` with score, predicted (score >= cut) and offending: the sentences whose
    own score reaches the cut, as code-point offsets (end exclusive) and scores."""
    results = ["score", "predicted", "offending"]
    own = Columns(docs, results, [text_col])
    rows = own.rows(text=own[text_col].cast("string"))
    spark_schema = boxed_schema(rows, "score double, predicted int, offending array<struct<start:int,end:int,score:double>>")
    schema = arrow_schema(docs.sparkSession, spark_schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weight, bias = shared.value
        table = np.zeros((1 << BITS) + 1)
        table[chosen] = weight  # feature -1 reads the last place, which stays 0
        for batch in batches:
            texts = vec.utf8(batch.column(1))
            for i, j in vec.chunks(texts):
                w = vec.Words(texts[i:j], vec.NON_ALNUM, fold=True)
                of_word, text_of, begin = sentences(w)
                z = bias + np.bincount(of_word, table[features(w)].sum(1), len(text_of))
                nothing = np.bincount(text_of, _softplus(z), j - i)
                nothing[w.counts() == 0] = _softplus(np.array(bias))
                total = -np.expm1(-nothing)
                bad: list[list[dict]] = [[] for _ in range(j - i)]
                p = _sigmoid(z)
                for s in np.flatnonzero(p >= cut).tolist():
                    d = int(text_of[s])
                    end = int(begin[s + 1]) if s + 1 < len(begin) and text_of[s + 1] == d else int(w.begin[d]) + len(texts[i + d])
                    a, b = int(begin[s] - w.begin[d]), end - int(w.begin[d])
                    head = len(texts[i + d][:a].decode(errors="ignore"))
                    bad[d].append({"start": head, "end": head + len(texts[i + d][a:b].decode(errors="ignore")), "score": float(p[s])})
                cols = [*(x.slice(i, j - i) for x in batch.columns), pa.array(total), pa.array((total >= cut).astype(np.int32)), pa.array(bad, schema.field("offending").type)]
                yield batch_of(cols, schema)

    return own.back(rows.mapInArrow(score, spark_schema), results, **{text_col: "text"})


def not_held_out(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, that the model doesn't reject."""
    model = train(docs, labels, not_held_out())
    own = Columns(docs, moved=["text"])
    scored = score_toxicity(own.rows(text=own["text"]), model)
    return own.back(scored.where("predicted = 0"), text="text")
