"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is cut into sentences, a sentence into spans: words with the marks
inside them (``id*iot``), and runs of single letters set apart (``i d i o
t``).  The string kernel compares two spans by the subsequences of ``ORDER``
characters they share, each weighed by ``DECAY`` to the length it stretches
over, so gapped and inserted characters lower the similarity only a little.
A span is compared with a landmark if it holds ``SCREEN`` of the landmark's
letters; else their similarity is 0.  Of a span with marks inside, the parts
between them and all its letters joined are compared as well.  A sentence's similarity to a landmark
is that of its best span; with the landmarks' own kernel matrix this gives
the Nyström features on which a linear support vector machine is trained.

It is trained on sentences of labelled texts, each with the label of its
text; the texts are a sample of bounded size, the same at every run.
Sentences are cut at 40 spans for the sample only.  Landmarks are the spans
that mark toxic texts best (log-likelihood ratio), and others that are most
like them.  A text's score is a logistic regression, fitted on the sample's
texts, over its two highest sentence margins, the number of its sentences
above the machine's boundary and its length.

Defined results: null and empty texts have no sentence and get the score of
a sentence without any similar span; null labels and labels of missing
documents are not used; without labels of both classes every score is near 0; repeated rows each get their row.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.llm.text import slices

ORDER, DECAY, SCREEN = 3, 0.9, 0.8
#: Power of the normalised kernel: higher powers tell similar words apart, lower ones bear more inserted characters.
POWER = 1.5
#: Longest landmark, and longest span compared at once; longer spans are compared in windows of twice a short, middle and long landmark's length that overlap by half.
LANDMARK, SPAN = 16, 32
WINDOWS = (8, 16, 32)
MEMO = 300_000
RESULT = ["score", "predicted"]

_TOKEN = re.compile(r"[^\W_](?:[ .*_-][^\W_](?![^\W_])){2,}|[^\W_]+(?:[^\w\s][^\W_]+)*|[.!?\n]+")
_STOP = frozenset(".!?\n")
_APART = re.compile(r"[^\w]|_")


def tokens(text: str) -> list[str]:
    """Lower-case spans, and runs of sentence ends, in order."""
    return _TOKEN.findall(text.lower())


def _codes(spans: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, spans), dtype=np.int64, count=len(spans))
    flat = np.frombuffer("".join(s.ljust(width, "\0") for s in spans).encode("utf-32-le"), dtype=np.uint32)
    return flat.reshape(len(spans), width), sizes


def _bins(codes: np.ndarray) -> np.ndarray:
    """Counts of characters, in 64 classes (a-z apart from each other)."""
    out = np.zeros((len(codes), 64), dtype=np.int8)
    rows, cols = np.nonzero(codes)
    np.add.at(out, (rows, codes[rows, cols] % 64), 1)
    return out


def _masks(bins: np.ndarray) -> np.ndarray:
    """The classes of characters that occur, a bit each."""
    return ((bins > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def string_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of each pair of rows; rows are code points, padded with 0."""
    n, width = t.shape
    far = np.arange(width)
    spread = np.where(far[None, :] >= far[:, None], decay ** (far[None, :] - far[:, None] + 2.0), 0.0).astype(np.float32)
    before = [np.ones((n, width), dtype=np.float32)] + [np.zeros((n, width), dtype=np.float32) for _ in range(order - 1)]
    total = np.zeros(n, dtype=np.float32)
    for a in range(s.shape[1]):
        x = s[:, a]
        if not x.any():
            break
        here = ((t == x[:, None]) & (x != 0)[:, None]).astype(np.float32)
        # before[i][:, j]: shared subsequences of length i of s[:a] and t[:j], stretched to their ends.
        total += (here * before[order - 1]).sum(axis=1) * decay * decay
        for i in range(order - 1, 0, -1):
            added = (here * before[i - 1]) @ spread
            before[i] *= decay
            before[i][:, 1:] += added[:, :-1]
    return total


class Similarity:
    """Similarity of spans to the landmarks; the spans seen last are remembered."""

    def __init__(self, landmarks: list[str], memo_size: int | None = None):
        self.landmarks, self.memo_size = landmarks, memo_size
        self._start()

    def __getstate__(self):
        return {"landmarks": self.landmarks, "memo_size": self.memo_size}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        self.codes, sizes = _codes(self.landmarks, LANDMARK)
        self.width = int(sizes.max(initial=1))
        self.bins = _bins(self.codes)
        self.masks = _masks(self.bins)
        self.least = np.maximum(ORDER, np.ceil(SCREEN * sizes - 1e-9)).astype(np.int64)
        #: A span that lacks so many of a landmark's characters fails the screen.
        self.kinds = np.bitwise_count(self.masks).astype(np.int64) - (sizes - self.least)
        self.norm = np.sqrt(string_kernel(self.codes, self.codes)) if self.landmarks else np.zeros(0)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.landmarks)), dtype=np.float16)
        self.used = 1  # row 0: similar to none

    def compare(self, spans: list[str]) -> np.ndarray:
        """Similarities (span, landmark) of short spans."""
        out = np.zeros((len(spans), len(self.landmarks)), dtype=np.float32)
        for at in range(0, len(spans), 10_000):
            codes, sizes = _codes(spans[at:at + 10_000], SPAN)
            order = np.argsort(sizes, kind="stable")  # spans of one length together: short ones take few steps
            codes, sizes = codes[order], sizes[order]
            bins = _bins(codes)
            masks = _masks(bins)
            rows, cols = [], []
            for j in range(len(self.landmarks)):
                some = np.flatnonzero(np.bitwise_count(masks & self.masks[j]) >= self.kinds[j])
                shared = np.minimum(bins[some], self.bins[j]).sum(axis=1, dtype=np.int64)
                some = some[shared >= self.least[j]]
                rows.append(some)
                cols.append(np.full(len(some), j))
            rows, cols = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*cols, np.zeros(0, np.int64)])
            by_span = np.argsort(rows, kind="stable")
            rows, cols = rows[by_span], cols[by_span]
            own = np.ones(len(codes), dtype=np.float32)
            touched = np.unique(rows)
            for k in range(0, len(touched), 2_000):
                r = touched[k:k + 2_000]
                s = codes[r, :sizes[r[-1]]]
                own[r] = np.sqrt(string_kernel(s, s))
            for k in range(0, len(rows), 2_000):
                r, c = rows[k:k + 2_000], cols[k:k + 2_000]
                like = string_kernel(codes[r, :sizes[r[-1]]], self.codes[c, :self.width])
                out[at + order[r], c] = (like / np.maximum(own[r] * self.norm[c], 1e-30)) ** POWER
        return out

    def index(self, spans: list[str]) -> np.ndarray:
        """Row of each span in ``rows``; 0 if it is similar to no landmark."""
        if len(self.memo) > (self.memo_size or MEMO):
            self._forget()
        new = list(set(spans) - self.memo.keys())
        for at in range(0, len(new), 10_000):
            self._learn(new[at:at + 10_000])
        return np.fromiter(map(self.memo.__getitem__, spans), dtype=np.int64, count=len(spans))

    def _learn(self, new: list[str]) -> None:
        pieces, owner = [], []
        for k, span in enumerate(new):
            if span[0] in _STOP:
                continue
            parts = [span]
            if len(joined := _APART.sub("", span)) != len(span):
                parts += [joined, *(x for x in _APART.split(span) if len(x) >= ORDER)]
            for part in parts:
                if len(part) <= SPAN:
                    pieces.append(part)
                    owner.append(k)
                else:
                    for width in WINDOWS:
                        cuts = range(0, len(part), width // 2)
                        pieces += [part[c:c + width] for c in cuts]
                        owner += [k] * len(cuts)
        value = np.zeros((len(new), len(self.landmarks)), dtype=np.float32)
        if pieces and self.landmarks:
            np.maximum.at(value, np.array(owner), self.compare(pieces))
        some = value.astype(np.float16).any(axis=1)
        need = self.used + int(some.sum())
        if need > len(self.rows):
            grown = np.zeros((max(need, len(self.rows) * 3 // 2), len(self.landmarks)), dtype=np.float16)
            grown[:self.used] = self.rows[:self.used]
            self.rows = grown
        row = np.zeros(len(new), dtype=np.int64)
        row[some] = np.arange(self.used, need)
        self.rows[self.used:need] = value[some]
        self.used = need
        self.memo.update(zip(new, row.tolist(), strict=True))

    def sentences(self, spans: list[str], first_of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, similarities) of every sentence that has a similar span."""
        index = self.index(spans)
        stop = np.fromiter((s[0] in _STOP for s in spans), dtype=bool, count=len(spans))
        some = np.flatnonzero(index)
        if not len(some):
            return np.zeros(0, dtype=np.int64), np.zeros((0, len(self.landmarks)), dtype=np.float32)
        text = np.searchsorted(first_of_text, some, side="right") - 1
        sentence = np.cumsum(stop)[some] + text
        begin = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
        return text[begin], np.maximum.reduceat(self.rows[index[some]].astype(np.float32), begin, axis=0)


class Model:
    """Landmarks, the Nyström map folded into one weight vector, bias, and the logistic over a text's sentences."""

    def __init__(self, landmarks: list[str], weight: np.ndarray, bias: float, logistic: np.ndarray):
        self.similarity = Similarity(landmarks)
        self.weight, self.bias, self.logistic = weight, bias, logistic

    def facts(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: highest and second highest sentence margin, log of its sentences above the boundary and of its spans, 1."""
        spans: list[str] = []
        first = [0]
        for text in texts:
            spans += tokens(text or "")
            first.append(len(spans))
        text, x = self.similarity.sentences(spans, np.array(first[:-1], dtype=np.int64))
        return _facts(text, x @ self.weight + self.bias, np.diff(first), self.bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.facts(texts) @ self.logistic, -60, 60)))


def _facts(text: np.ndarray, margin: np.ndarray, sizes: np.ndarray, bias: float) -> np.ndarray:
    margin = np.clip(margin, -2, 2)
    order = np.lexsort((-margin, text))
    text, margin = text[order], margin[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    out = np.full((len(sizes), 5), max(bias, -2.0))
    for k in range(2):
        out[text[rank == k], k] = np.maximum(margin[rank == k], out[0, k] if len(out) else 0)
    out[:, 2] = np.log1p(np.bincount(text[margin > 0], minlength=len(sizes)))
    out[:, 3] = np.log1p(sizes)
    out[:, 4] = 1
    return out


def _cut(text: str) -> list[list[str]]:
    """Sentences of a text as lists of spans, cut at 40 spans."""
    out, now = [], []
    for token in [*tokens(text), "."]:
        if token[0] in _STOP or len(now) == 40:
            if now:
                out.append(now)
            now = []
        if token[0] not in _STOP:
            now.append(token)
    return out


def choose_landmarks(documents: list[list[list[str]]], toxic: list[int], count: int, least: int = 3) -> list[str]:
    """Spans with the highest log-likelihood ratio for toxic texts, and half as many others that are most like them."""
    seen: dict[str, list[int]] = {}
    for sentences, label in zip(documents, toxic, strict=True):
        for s in {s for x in sentences for s in x}:
            if ORDER <= len(s) <= LANDMARK:
                seen.setdefault(s, [0, 0])[label] += 1
    share = sum(toxic) / len(toxic)
    scored, others = [], []
    for s, (clean, bad) in seen.items():
        n = clean + bad
        if bad >= least and bad / n > (1 + share) / 2:
            ratio = bad * math.log(bad / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0)
            scored.append((-ratio, s))
        elif clean >= least:
            others.append(s)
    chosen = [s for _, s in sorted(scored)[:count]]
    if chosen and others:
        alike = Similarity(chosen).compare(others).max(axis=1)
        closest = sorted((-a, s) for a, s in zip(alike.tolist(), others, strict=True) if a > 0.2)[:count // 2]
        chosen += [s for _, s in closest]
    return chosen


def train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps on the points inside the margin; y is -1 or 1."""
    m = x.shape[1]
    ridge = penalty * np.append(np.ones(m), 0)
    weight = weight / weight.sum()
    w = np.zeros(m + 1)

    def loss(v):
        return weight @ (np.maximum(0, 1 - y * (x @ v[:-1].astype(x.dtype) + v[-1])) ** 2) + ridge @ (v * v)

    for _ in range(rounds):
        inside = np.flatnonzero(y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1)
        gram, right = np.diag(ridge), np.zeros(m + 1)
        for at in range(0, len(inside), 8192):
            rows = inside[at:at + 8192]
            block = np.hstack([x[rows].astype(np.float64), np.ones((len(rows), 1))])
            scaled = block * weight[rows, None]
            gram = gram + scaled.T @ block
            right += scaled.T @ y[rows]
        new = np.linalg.lstsq(gram, right, rcond=None)[0]
        step = 1.0
        while step > 1e-3 and loss(w + step * (new - w)) > loss(w):
            step /= 2
        if step <= 1e-3 or np.allclose(w, new, atol=1e-6):
            break
        w = w + step * (new - w)
    return w[:-1], float(w[-1])


def train_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; y is 0 or 1."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Sentences that fit compares at a time.
SENTENCES = 8192


def sample_labelled(docs: DataFrame, labels: DataFrame, max_chars: int = 8_000_000) -> DataFrame:
    """text and toxic of labelled documents that are not held out: about ``max_chars`` characters of them, by the hash of
    the text.  Texts longer than a 200th of that are not sampled."""
    known = (docs.select("doc_id", F.length("text").alias("n"), F.pmod(F.xxhash64("text"), F.lit(1 << 20)).alias("draw"))
             .join(labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id")
             .filter((F.col("n") <= max_chars // 200) & ~held_out("doc_id")))
    total = known.agg(F.sum("n")).first()[0] or 0
    chosen = known.filter(F.col("draw") < min(1.0, max_chars / max(1, total)) * (1 << 20)).select("doc_id", "toxic").distinct()
    # Bounded by max_chars, as a text of the sample has a character at least.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("length(text) > 0").select("text", "toxic")


def fit(sample: DataFrame, landmarks: int = 128) -> Model:
    """Train on the rows of ``sample`` (text, toxic 0 or 1), which the driver reads: see sample_labelled for their bound."""
    rows = sorted(sample.select("text", F.col("toxic").cast("int").alias("toxic")).filter("text is not null and toxic in (0, 1)").distinct().collect())
    known: dict[str, str] = {}
    documents = [[[known.setdefault(s, s) for s in x] for x in _cut(r.text)] for r in rows]
    labels = np.array([r.toxic for r in rows], dtype=np.int64)
    del rows
    chosen = choose_landmarks(documents, labels.tolist(), landmarks) if 0 < labels.sum() < len(labels) else []
    if not chosen:
        return Model([], np.zeros(0), -1.0, np.array([60.0, 0, 0, 0, 0]))
    similarity = Similarity(chosen)
    sentences = [x for d in documents for x in d]
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    sizes = np.bincount(owner, weights=[len(x) for x in sentences], minlength=len(documents))
    count = len(sentences)
    parts = []
    for at in range(0, count, SENTENCES):  # a row a span is held of so many sentences only
        some = sentences[at:at + SENTENCES]
        index, similar = similarity.sentences([s for x in some for s in x], np.cumsum([0] + [len(x) for x in some])[:-1])
        parts.append((index + at, similar))
    del documents, sentences, some
    index = np.concatenate([i for i, _ in parts])
    x = np.zeros((len(index) + 2, len(chosen)), dtype=np.float32)
    np.concatenate([x for _, x in parts], out=x[:-2])
    del parts, similar
    similarity._forget()
    kernel = similarity.compare(chosen).astype(np.float64)
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
    root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    # Sentences without any similar span are all alike: two weighted rows stand for them.
    y = 2.0 * labels[owner] - 1
    rest = np.ones(count, dtype=bool)
    rest[index] = False
    root32 = root.astype(np.float32)
    for at in range(0, len(index), SENTENCES):
        x[at:at + SENTENCES] = x[at:at + SENTENCES] @ root32
    weight, bias = train_machine(x, np.append(y[index], [-1, 1]), np.append(np.ones(len(index)), [(y[rest] < 0).sum(), (y[rest] > 0).sum()]))
    margin = np.concatenate([x[at:at + SENTENCES] @ weight for at in range(0, len(x), SENTENCES)])[:-2] + bias
    facts = _facts(owner[index], margin, sizes, bias)
    return Model(chosen, root @ weight, bias, train_logistic(facts, labels))


def _score(model, columns):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                score = model.value.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())], [*columns, *RESULT])
    return run


def score_toxicity(docs: DataFrame, model: Model, memo_size: int | None = None) -> DataFrame:
    """``docs`` (needs ``text``) with score (0 to 1) and predicted (0 or 1); columns of these names are replaced.

    ``memo_size``: spans that a worker remembers, for less memory or less time; it changes no score.
    """
    docs = docs.drop(*RESULT)
    model.similarity.memo_size = memo_size
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), docs.columns), schema)


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
