"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score for bad is linear in its own features and those of the lines before and after it,
and neighbouring labels interact through transition weights. Lines are labelled by their document's label for training;
weights come from maximum likelihood with a quadratic penalty (gradient by forward-backward, L-BFGS steps). A document's
quality is the mean log-odds of its lines' forward-backward marginals, weighted by line length, put through a logistic
curve fitted on the same training documents.

The model is fitted on at most MAX_TRAINING labelled documents (those of the smallest hashes, texts of MAX_TRAINING_BYTES
together), so training is bounded whatever the corpus's size and its texts' lengths; scoring is one pass over whole texts without a shuffle. Features are computed on byte
arrays; a task holds one chunk of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, map_rows, only, text_or_empty

MAX_TRAINING, MAX_TRAINING_BYTES = 4000, 32 << 20
MOST_MOVE = 2.0  # bound of the transition weights
N_OWN = 16
N_FEATURES = 3 * N_OWN + 2
# Byte classes: 0 other, 1 lower-case or beyond ASCII, 2 upper-case, 3 digit, 4 blank, 5 sentence mark, 6 symbol, 7 vertical bar.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{}~"]] = 6
_CLASS[ord("|")] = 7


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line (those of the line before and after beside its own) and the lines' lengths in bytes.

    Blank lines are lines of length 0 and weigh nothing; an empty text is one such line.
    """
    raw = np.frombuffer(text.encode() + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, size = len(ends), (ends - starts).astype(np.float64)
    kind = _CLASS[raw]
    blank = (kind == 4) | (raw == 10)
    first = ~blank & np.concatenate(([True], blank[:-1]))  # first byte of each word
    word = np.flatnonzero(first)
    word_end = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1
    line_of = np.searchsorted(ends, word)
    count = np.bincount(line_of, minlength=n).astype(np.float64)
    sums = {k: np.add.reduceat(kind == k, starts, dtype=np.float64) for k in (1, 2, 3, 5, 6, 7)}
    # Words as polynomial sums of their bytes, modulo 2^64: equal words have equal sums.
    power = np.cumprod(np.full(min(len(raw), 64), 0x9E3779B97F4A7C15 | 1, np.uint64))
    if len(word):
        length = word_end - word
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        letters = raw[np.repeat(word, length) + inside].astype(np.uint64) + np.uint64(1)
        code = np.add.reduceat(letters * power[np.minimum(inside, len(power) - 1)], np.cumsum(length) - length)
        same = np.zeros(len(word), bool)
        same[1:] = (code[1:] == code[:-1]) & (line_of[1:] == line_of[:-1])
        repeated = np.bincount(line_of, weights=same, minlength=n)
        pairs = np.unique(np.stack((line_of.astype(np.uint64), code)), axis=1) if len(word) < 2 else _distinct(line_of, code)
        distinct = np.bincount(pairs[0].astype(np.int64), minlength=n).astype(np.float64)
        short = np.bincount(line_of, weights=length <= 3, minlength=n)
        letters_in = np.bincount(line_of, weights=length, minlength=n)
        last = raw[word_end - 1]
        marked = np.bincount(line_of, weights=_CLASS[last] == 6, minlength=n)
        whole = np.zeros(n, np.uint64)
        np.add.at(whole, line_of, code * (np.arange(len(word)) - (np.cumsum(count) - count)[line_of] + 1).astype(np.uint64))
    else:
        repeated = distinct = short = letters_in = marked = np.zeros(n)
        whole = np.zeros(n, np.uint64)
    _, which, times = np.unique(whole, return_inverse=True, return_counts=True)
    copies = np.where(count > 0, times[which], 1).astype(np.float64)
    some, words = np.maximum(size, 1), np.maximum(count, 1)
    letters_ = np.maximum(sums[1] + sums[2], 1)
    own = np.stack(
        [
            np.log1p(size) / 6, np.log1p(count) / 5, sums[2] / letters_, (sums[2] > 0.6 * letters_) * 1.0, sums[3] / some, sums[5] / some * 5,
            np.minimum(sums[6] / words, 4) / 2, marked / words, sums[7] / words, repeated / words, distinct / words, short / words,
            letters_in / words / 10, np.minimum(np.log(copies), 4), (size == 0) * 1.0, (count > 8) * (sums[5] == 0),
        ],
        axis=1,
    )
    edge = np.zeros((1, N_OWN))
    ends_of_text = np.zeros((n, 1))
    ends_of_text[[0, -1]] = 1
    return np.hstack((own, np.vstack((edge, own[:-1])), np.vstack((own[1:], edge)), ends_of_text, np.ones((n, 1)))), size


def _distinct(line: np.ndarray, code: np.ndarray) -> np.ndarray:
    order = np.lexsort((code, line))
    line, code = line[order], code[order]
    new = np.concatenate(([True], (line[1:] != line[:-1]) | (code[1:] != code[:-1])))
    return np.stack((line[new], code[new].astype(np.int64)))


@dataclass
class LineCrf:
    weights: np.ndarray  # of a bad line, per feature
    moves: np.ndarray  # 2 x 2: from, to
    curve: tuple[float, float, float]  # logistic curve: slope, offset, weight of the worst stretch

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each text: length-weighted mean log-odds of good, and the share of its length in bad lines."""
        parts = [line_features(t) for t in texts]
        bad = _marginals([x @ self.weights for x, _ in parts], self.moves)
        out = np.zeros((len(texts), 2))
        for k, (p, (_, size)) in enumerate(zip(bad, parts, strict=True)):
            p = np.clip(p, 1e-6, 1 - 1e-6)
            share = size / size.sum() if size.sum() else np.full(len(size), 1 / len(size))
            out[k] = (share * np.log((1 - p) / p)).sum(), (share * p).sum()
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        odds, share = self.evidence(texts).T
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * odds + self.curve[1] + self.curve[2] * share, -30, 30)))


def _lanes(scores: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sequences side by side, longest first: order, lengths, positions x sequences."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order])
    return order, lengths, np.concatenate(([0], np.cumsum(lengths)))


def _marginals(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    return _forward_backward(scores, moves)[0]


def _forward_backward(scores: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray]:
    """Marginals of bad, the sum of log partition functions, expected moves; state 0 is good (score 0), 1 bad."""
    order, lengths, starts = _lanes(scores)
    flat = np.concatenate([scores[k] for k in order])
    jump = np.exp(moves)
    top = int(lengths[0])
    live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(top)]
    emit = np.stack((np.exp(-np.maximum(flat, 0)), np.exp(np.minimum(flat, 0))), axis=1)  # over exp(max(score, 0))
    total = float(np.maximum(flat, 0).sum())
    ahead, back = np.zeros_like(emit), np.ones_like(emit)
    for t in range(top):
        at = starts[: live[t]] + t
        a = emit[at] * (ahead[at - 1] @ jump) if t else emit[at]
        norm = a.sum(axis=1, keepdims=True)
        total += float(np.log(norm).sum())
        ahead[at] = a / norm
    moved = np.zeros((2, 2))
    for t in range(top - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        right = emit[at + 1] * back[at + 1]
        both = ahead[at][:, :, None] * jump[None] * right[:, None, :]
        moved += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = right @ jump.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    bad = both[:, 1] / both.sum(axis=1)
    out: list[np.ndarray] = [None] * len(scores)
    for lane, k in enumerate(order):
        out[k] = bad[starts[lane] : starts[lane + 1]]
    return out, total, moved


def train(texts: list[str], good: list[int], penalty: float = 1.0, steps: int = 60) -> LineCrf:
    """Fits weights, moves and the curve; without examples of both kinds every text scores by prior alone."""
    if len(set(good)) < 2:
        share = float(np.clip(np.mean(good), 0.01, 0.99)) if good else 0.5
        return LineCrf(np.zeros(N_FEATURES), np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share))), 0.0))
    parts = [line_features(t)[0] for t in texts]
    rows = np.concatenate(parts)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    bad = np.array([1 - g for g in good])
    truth = np.repeat(bad, [len(p) for p in parts])
    seen_moves = np.zeros((2, 2))
    for g, p in zip(bad, parts, strict=True):
        seen_moves[g, g] += len(p) - 1
    seen = rows[truth == 1].sum(axis=0)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, bent = theta[:N_FEATURES], np.tanh(theta[N_FEATURES:]).reshape(2, 2)
        moves = MOST_MOVE * bent
        flat = rows @ w
        marginals, total, moved = _forward_backward(np.split(flat, cuts), moves)
        value = total - float(flat[truth == 1].sum()) - float((seen_moves * moves).sum()) + penalty * float(theta @ theta) / 2
        grad = np.concatenate((rows.T @ np.concatenate(marginals) - seen, ((moved - seen_moves) * MOST_MOVE * (1 - bent**2)).ravel())) + penalty * theta
        return value, grad

    theta = _lbfgs(loss, np.zeros(N_FEATURES + 4), steps)
    # Labels of whole documents make staying in a label nearly certain; the bound, under which all weights are fitted,
    # lets lines disagree.
    model = LineCrf(theta[:N_FEATURES], MOST_MOVE * np.tanh(theta[N_FEATURES:]).reshape(2, 2), (1.0, 0.0, 0.0))
    x = np.hstack((model.evidence(texts), np.ones((len(texts), 1))))[:, [0, 2, 1]]
    y = np.array(good, np.float64)

    def curve_loss(c: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ c
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * c @ c), x.T @ (p - y) + c

    slope, offset, worst = _lbfgs(curve_loss, np.zeros(3), 60)
    return LineCrf(model.weights, model.moves, (float(slope), float(offset), float(worst)))


def _lbfgs(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a backtracking line search."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, r = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.abs(grad).sum()))
        for (s, y, r), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - r * (y @ q))
        step, slope = 1.0, float(grad @ q)
        if slope <= 0:
            break
        for _ in range(25):
            new, new_grad = f(x - step * q)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_grad - grad
        x = x + s
        if s @ y > 1e-10:
            past = [*past[-memory + 1 :], (s, y, 1 / float(s @ y))]
        done = value - new < 1e-7 * max(1.0, abs(value))
        value, grad = new, new_grad
        if done:
            break
    return x


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves 2 modulo 4: such rows' labels are never read."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, max_bytes: int = MAX_TRAINING_BYTES) -> LineCrf:
    """Trains on labelled rows that aren't held out: at most max_training of them, those of the smallest doc_id hashes.

    Labels other than 0 and 1 and rows without a doc_id are passed over; a doc_id with several labels takes the smallest,
    one with several texts the shortest. In the order of the hashes, a text that would make the training texts longer than
    max_bytes together is left out; texts that are used are whole.
    """
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training).collect()
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_id", F.xxhash64("text"))
    ids = spark.createDataFrame(chosen, "doc_id long, quality int")
    lengths = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.octet_length("text").alias("size"), "text_id")).alias("least"))
    least = {r.doc_id: r.least for r in lengths.collect()}
    taken, total = [], 0
    for doc_id, good in chosen:
        if doc_id in least and total + least[doc_id].size <= max_bytes:
            taken.append((doc_id, good, least[doc_id].text_id))
            total += least[doc_id].size
    picks = spark.createDataFrame(taken, "doc_id long, quality int, text_id long")
    found = texts.join(F.broadcast(picks), ["doc_id", "text_id"]).groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))
    rows = sorted(tuple(r) for r in found.collect())
    return train([t for _, _, t in rows], [q for _, q, _ in rows])


def score_documents(docs: DataFrame, model: LineCrf, accept: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text).

    The score reads the text alone; null texts score as empty ones. Repeated rows are scored alike; a null doc_id is
    kept (held_out as for the empty string). Other columns are ignored.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        chunk: list[tuple] = []
        size = 0
        for row in rows:
            chunk.append(row)
            size += len(row[2])
            if len(chunk) == 128 or size > 2_000_000:
                yield from judge(chunk)
                chunk, size = [], 0
        if chunk:
            yield from judge(chunk)

    def judge(chunk: list[tuple]) -> Iterator[tuple]:
        for (doc_id, out, _), s in zip(chunk, model.score([t for _, _, t in chunk]).tolist(), strict=True):
            yield doc_id, out, s, int(s >= accept)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return map_rows(source, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_accepted(docs: DataFrame, model: LineCrf, accept: float = 0.7) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores at least accept; one pass in place, without a shuffle."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("")
        for batch in batches:
            size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(where)), 0).to_numpy())))
            at = 0
            while at < batch.num_rows:  # at most 128 rows, of about 2 MB together or one row
                n = max(1, min(128, int(np.searchsorted(size, size[at] + 2_000_000, side="right")) - 1 - at))
                part = batch.slice(at, n)
                score = model.score([t or "" for t in part.column(where).to_pylist()])
                yield part.filter(pa.array(score >= accept))
                at += n
        give_back()

    return docs.mapInArrow(run, docs.schema)
