"""Language-model scoring with a log-bilinear model.

The model predicts a word's class from the two words before it, and the word
inside its class from the class before: the context vector is ``c1 * r[w1] +
c2 * r[w2]`` (elementwise), a class scores its inner product with it plus a
bias, and so does a word among those of its class.  The most frequent words
are classes of their own; the other listed words, by frequency, share classes
of ``tail`` words.  All words beyond the list are dealt by hash to at most
``buckets`` buckets, which are modelled as listed words are, so that the
context counts for every word; inside its bucket a word has its smoothed
corpus frequency, and one share is left for words that the corpus lacks.

Parameters are fitted with noise-contrastive estimation over every training
token, in ``rounds`` rounds that each take their own part of the texts.  A
round's texts are dealt by hash to shards of about ``shard_tokens`` tokens;
each shard runs minibatch steps, shorter towards its end, from the last
round's parameters, and the results are averaged (a word of a shared class over the shards that hold it), in a tree
whose depth grows with the shards: no group adds up more than ``fan_in``
rows, and a row holds the common parameters or ``sum_words`` words.
Shards depend on the texts alone, so scores don't change with the partitions,
and a shard is as long at any size of the corpus.  The normaliser of every
context is computed once with batched matrix products, so that the scores are
true log-probabilities.

Corpus counts are Spark aggregations over every word.  The counts of at most
``head`` listed words (a fixed number; the least count comes from a histogram
of counts) and of the buckets travel with the tasks; occurrences of all other
words are joined with the count table by word.

Defined results: null or empty text has the end token only; a null
``doc_id`` counts as the empty text when documents are held out; repeated
rows are scored each; other columns are not read; without training documents
all counts are zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.scratch import Scratch
from notegraph.llm.shingles import block_words, lower, text_blocks, word_hashes
from notegraph.llm.text import ascii_lower, words

END = ""


@dataclass(frozen=True)
class LogBilinear:
    """Sizes and steps of the model; all are fixed, none grows with the data."""

    head: int = 200_000
    buckets: int = 65_536
    classes: int = 1024
    dim: int = 16
    noise: int = 32
    tail: int = 512
    tail_dim: int = 8
    tail_noise: int = 2
    batch: int = 1024
    step: float = 0.1
    tail_step: float = 0.05
    decay: float = 0.95
    rounds: int = 2
    shard_tokens: int = 2_000_000
    piece: int = 65_536
    fan_in: int = 64
    sum_words: int = 8192
    held_out_mod: int = 10
    smooth: float = 0.1
    seed: int = 11


def held_out(doc_id: Column, mod: int, remainder: int = 0) -> Column:
    """True where crc32 of the id as text leaves ``remainder``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod == remainder


def token_counts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, c)`` of all tokens of ``docs``; the end token is ''."""
    tokens = docs.select(F.explode(F.concat(words(ascii_lower(F.col("text"))), F.array(F.lit(END)))).alias("word"))
    return scratch.keep(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("c")), "counts")


class Lookup:
    """Word hash to index of a fixed list, by open addressing, or to a bucket beyond it."""

    def __init__(self, items: list[str], buckets: int):
        self.size, self.buckets = len(items), buckets
        # a list of words hashes as one text; END has no bytes and index 0
        _, _, h = word_hashes(np.frombuffer(" ".join(items).encode(), np.uint8))
        self.bits = max(4, int(2 * len(h)).bit_length())
        self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = left[self.value[slot[left]] < 0]
            self.value[slot[free]] = free
            self.key[slot[free]] = h[free]
            left = left[self.key[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the list, -1 where it has none."""
        out, slot, left = np.full(len(h), -1, np.int32), self._slot(h), np.arange(len(h))
        while len(left):
            at = slot[left]
            same = self.key[at] == h[left]
            out[left[same]] = self.value[at[same]]
            left = left[~same & (self.value[at] >= 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def index(self, h: np.ndarray) -> np.ndarray:
        """1 + i for the i-th word of the list; a bucket's index comes after all of those."""
        found = self.find(h)
        return np.where(found >= 0, found, self.size + (h % np.uint64(self.buckets)).astype(np.int32)) + 1


def encoded(column: pa.Array, lookup: Lookup) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts as (first row, word indices, bytes, starts, ends).

    Each text's words are followed by the end token, whose start is -1; an
    index is 0 for the end token, else that of ``Lookup.index``.
    """
    for first, raw, at in text_blocks(column):
        data = np.full(len(raw) + len(at) - 1, 32, np.uint8)
        keep = np.ones(len(data), bool)
        keep[at[1:] + np.arange(len(at) - 1)] = False
        data[keep] = lower(raw)
        start, end, h = word_hashes(data)
        found = lookup.index(h)
        stops = np.searchsorted(start, at[1:] + np.arange(1, len(at)))
        yield first, np.insert(found, stops, 0), data, np.insert(start, stops, -1), np.insert(end, stops, -1)


@dataclass
class Vocabulary:
    """Classes of listed words and buckets, and what is known of them before training."""

    own: int
    table: np.ndarray
    log_noise: np.ndarray
    tail_log: np.ndarray

    @staticmethod
    def of(c: np.ndarray, buckets: np.ndarray, m: LogBilinear) -> Vocabulary:
        """From the listed words' counts, most frequent first, and the buckets' counts."""
        own, every = min(m.classes - 1, len(c)), np.append(c, buckets)
        table = np.concatenate((np.arange(own), own + np.arange(len(every) - own) // m.tail)).astype(np.int64)
        weight = np.bincount(table, every) + m.smooth
        within = np.bincount(table[own:], every[own:] + m.smooth, len(weight))[table[own:]]
        return Vocabulary(own, table, np.log(weight / weight.sum()), np.log((every[own:] + m.smooth) / within))

    def sizes(self) -> np.ndarray:
        """Words of each class."""
        return np.bincount(self.table)


@dataclass
class Params:
    r: np.ndarray
    t: np.ndarray
    b: np.ndarray
    c: np.ndarray
    #: Words of shared classes: context vectors of classes, word vectors, biases.
    q: np.ndarray
    u: np.ndarray
    v: np.ndarray

    @staticmethod
    def start(log_unigram: np.ndarray, m: LogBilinear, tail_log: np.ndarray | None = None) -> Params:
        rng = np.random.default_rng(m.seed)
        n, tail_log = len(log_unigram), np.zeros(0) if tail_log is None else tail_log
        r, t = (rng.normal(0, 0.1, (n, m.dim)).astype(np.float32) for _ in range(2))
        q, u = (rng.normal(0, 0.1, (k, m.tail_dim)).astype(np.float32) for k in (n, len(tail_log)))
        return Params(r, t, log_unigram.astype(np.float32), np.ones((2, m.dim), np.float32), q, u, tail_log.astype(np.float32))

    def common(self) -> list[np.ndarray]:
        """What every shard moves: all but the words of shared classes."""
        return [self.r, self.t, self.b, self.c, self.q]

    def copy(self) -> Params:
        return Params(*(x.copy() for x in (self.r, self.t, self.b, self.c, self.q, self.u, self.v)))


def context(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before; the end token starts a text."""
    w1 = np.concatenate(([0], classes[:-1]))
    w2 = np.concatenate(([0], w1[:-1]))
    w2[w1 == 0] = 0
    return w1, w2


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    d = values.shape[1]
    flat = (rows[:, None] * d + np.arange(d)).ravel()
    return np.bincount(flat, values.ravel(), n * d).reshape(n, d).astype(np.float32)


class Trainer:
    """Noise-contrastive Adagrad steps; noise classes are shared by a batch.

    ``left`` is the share of the step that is left: it falls by ``decay``
    over a shard, so that the last batches add little noise.
    """

    def __init__(self, p: Params, words: Vocabulary, m: LogBilinear, salt: tuple[int, ...]):
        self.p, self.m, self.words = p, m, words
        self.log_noise = words.log_noise.astype(np.float32)
        self.cdf = np.cumsum(np.exp(words.log_noise))
        sizes = words.sizes()
        self.first, self.size = np.cumsum(sizes) - sizes - words.own, sizes
        self.log_size = np.log(np.maximum(sizes, 1) / m.tail_noise).astype(np.float32)
        self.rng = np.random.default_rng((m.seed, *salt))
        self.square = [np.full_like(x, 1e-2) for x in (*p.common(), p.u, p.v)]
        self.seen = np.zeros(len(p.v), np.int64)
        self.tokens, self.left = 0, 1.0

    def learn(self, found: np.ndarray, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> None:
        p, n, k = self.p, len(self.p.b), self.m.noise
        drawn = np.minimum(np.searchsorted(self.cdf, self.rng.random(k) * self.cdf[-1]), n - 1)
        r1, r2 = p.r[w1], p.r[w2]
        q = p.c[0] * r1 + p.c[1] * r2
        log_k = np.float32(np.log(k))
        t_true, t_false = p.t[w], p.t[drawn]
        true = (q * t_true).sum(1) + p.b[w] - log_k - self.log_noise[w]
        false = q @ t_false.T + p.b[drawn] - log_k - self.log_noise[drawn]
        g_true = -1 / (1 + np.exp(np.minimum(true, 30)))
        g_false = 1 / (1 + np.exp(np.minimum(-false, 30)))
        g_q = g_true[:, None] * t_true + g_false @ t_false
        target = np.concatenate((w, drawn))
        g_t = _scatter(target, np.concatenate((g_true[:, None] * q, g_false.T @ q)), n)
        g_b = np.bincount(target, np.concatenate((g_true, g_false.sum(0))), n).astype(np.float32)
        g_r = _scatter(np.concatenate((w1, w2)), np.concatenate((g_q * p.c[0], g_q * p.c[1])), n)
        g_c = np.stack(((g_q * r1).sum(0), (g_q * r2).sum(0)))
        for x, g, s in zip((p.r, p.t, p.b, p.c), (g_r, g_t, g_b, g_c), self.square, strict=False):
            s += g * g
            x -= self.m.step * self.left * g / np.sqrt(s)
        self.tokens += len(w)
        inside = found >= self.words.own
        if inside.any():
            self._within(found[inside] - self.words.own, w[inside], w1[inside])

    def _within(self, word: np.ndarray, of: np.ndarray, before: np.ndarray) -> None:
        """Steps of words among those of their class; noise words are drawn evenly."""
        p, k = self.p, self.m.tail_noise
        size = self.size[of][:, None]
        noise = self.first[of][:, None] + (self.rng.random((len(word), k)) * size).astype(np.int64)
        every = np.concatenate((word[:, None], noise), 1)
        q, u = p.q[before], p.u[every]
        z = np.einsum("nd,nkd->nk", q, u) + p.v[every] + self.log_size[of][:, None]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g[:, 0] -= 1
        rows, at = np.unique(every, return_inverse=True)
        g_u = _scatter(at.ravel(), (g[:, :, None] * q[:, None]).reshape(-1, q.shape[1]), len(rows))
        g_v = np.bincount(at.ravel(), g.ravel(), len(rows)).astype(np.float32)
        g_q = _scatter(before, np.einsum("nk,nkd->nd", g, u), len(p.q))
        self.square[4] += g_q * g_q
        p.q -= self.m.tail_step * self.left * g_q / np.sqrt(self.square[4])
        for x, gx, s in ((p.u, g_u, self.square[5]), (p.v, g_v, self.square[6])):
            s[rows] += gx * gx
            x[rows] -= self.m.tail_step * self.left * gx / np.sqrt(s[rows])


PIECES = "round int, shard int, key bigint, part int, words binary"
SUMS = "shard int, part int, n bigint, common binary, at binary, seen binary, moved binary"


def _spot(key: np.ndarray, part: int) -> np.ndarray:
    """Where a text's part falls among rounds and shards."""
    return (key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part * 0xBF58476D1CE4E5B9 % 2**64)) >> np.uint64(20)


def _pieces(docs: DataFrame, lookup, shards: int, m: LogBilinear, turn: int) -> DataFrame:
    """Texts of a round as word indices, cut at ``piece`` words, with their shard.

    A text of fewer than ``piece`` bytes is one piece, so that it is only
    encoded in the round of that piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero((sizes >= m.piece) | (_spot(keys, 0) % np.uint64(m.rounds) == turn))))
            keys = batch.column(0).to_numpy()
            for first, found, *_ in encoded(batch.column(1), lookup.value):
                ends = np.flatnonzero(found == 0) + 1
                rows: list[tuple] = []
                for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
                    key = int(keys[first + i])
                    for part, at in enumerate(range(a, b, m.piece)):
                        spot = (key * 0x9E3779B97F4A7C15 + part * 0xBF58476D1CE4E5B9) % 2**64 >> 20
                        if spot % m.rounds != turn:
                            continue
                        rows.append((turn, spot // m.rounds % shards, key, part, found[at : min(at + m.piece, b)].astype(np.int32).tobytes()))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["round", "shard", "key", "part", "words"])

    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(cut, PIECES)


def _sums(shard: int, rows: list[tuple]) -> pa.Table:
    """Rows ``(part, n, common, at, seen, moved)`` of one shard."""
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    cols = [pa.array([shard] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
    return pa.table(cols, names=[x.split()[0] for x in SUMS.split(", ")])


def _averaged(group: pa.Table) -> pa.Table:
    """One part of several shards as one row, weighted by tokens and by each word's count."""
    group = group.sort_by("shard")
    into, part = (group.column(c)[0].as_py() for c in ("into", "part"))
    each = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in group.column(name)]
    if not part:
        return _sums(into, [(0, pc.sum(group.column("n")).as_py(), sum(each("common", np.float64)).tobytes(), b"", b"", b"")])
    ats = each("at", np.int32)
    words = np.unique(np.concatenate(ats))
    seen, moved = np.zeros(len(words), np.int64), 0
    for at, k, x in zip(ats, each("seen", np.int32), each("moved", np.float32), strict=True):
        x = x.reshape(len(at), -1)
        if not seen.any():
            moved = np.zeros((len(words), x.shape[1]))
        spot = np.searchsorted(words, at)
        seen[spot] += k
        moved[spot] += x * k[:, None].astype(np.int64)
    mean = (moved / seen[:, None]).astype(np.float32)
    return _sums(into, [(part, 0, b"", words.tobytes(), np.minimum(seen, 2**31 - 1).astype(np.int32).tobytes(), mean.tobytes())])


def _fitter(turn: int, last, words, m: LogBilinear) -> Callable[[pa.Table], pa.Table]:
    """What one shard of a round does: steps over its texts from the last parameters."""

    def fit(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("part").to_numpy(), group.column("key").to_numpy()))
        texts = group.column("words").take(pa.array(order))
        own = Trainer(last.value.copy(), words.value, m, (turn, group.column("shard")[0].as_py()))
        size, held = 0, []
        every = sum(len(x.as_buffer()) for x in texts) // 4
        for i, text in enumerate(texts):
            held.append(np.frombuffer(text.as_buffer(), np.int32))
            size += len(held[-1])
            if size >= 16 * m.batch or i == len(texts) - 1:
                found = np.concatenate(held)
                w = words.value.table[found]
                w1, w2 = context(w)
                own.seen += np.bincount(found[found >= words.value.own] - words.value.own, minlength=len(own.seen))
                for at in range(0, len(w), m.batch):
                    own.left = 1 - m.decay * own.tokens / every
                    own.learn(*(x[at : at + m.batch] for x in (found, w, w1, w2)))
                size, held = 0, []
        common = np.concatenate([x.ravel() for x in own.p.common()]).astype(np.float64) * own.tokens
        rows = [(0, own.tokens, common.tobytes(), b"", b"", b"")]
        for part, first in enumerate(range(0, len(own.seen), m.sum_words), 1):
            at = first + np.flatnonzero(own.seen[first : first + m.sum_words])
            if len(at):
                moved = np.hstack((own.p.u[at], own.p.v[at][:, None]))
                rows.append((part, 0, b"", *(x.tobytes() for x in (at.astype(np.int32), own.seen[at].astype(np.int32), moved))))
        return _sums(group.column("shard")[0].as_py(), rows)

    return fit


def train(docs: DataFrame, lookup, start: Params, words: Vocabulary, n_tokens: int, m: LogBilinear) -> Params:
    """Parameters fitted over all of ``docs``."""
    shards = max(1, -(-n_tokens // (m.rounds * m.shard_tokens)))
    words, now = docs.sparkSession.sparkContext.broadcast(words), start
    for turn in range(m.rounds):
        last = docs.sparkSession.sparkContext.broadcast(now)

        each = _pieces(docs, lookup, shards, m, turn).select("shard", "key", "part", "words").groupBy("shard").applyInArrow(_fitter(turn, last, words, m), SUMS)
        left = shards
        while True:
            each = each.withColumn("into", F.floor(F.col("shard") / m.fan_in).cast("int")).groupBy("part", "into").applyInArrow(_averaged, SUMS)
            if left <= m.fan_in:
                break
            left = -(-left // m.fan_in)
        now = now.copy()
        for r in each.collect():
            if r["part"]:
                at = np.frombuffer(r["at"], np.int32)
                moved = np.frombuffer(r["moved"], np.float32).reshape(len(at), -1)
                now.u[at], now.v[at] = moved[:, :-1], moved[:, -1]
            else:
                flat, spot = np.frombuffer(r["common"], np.float64) / r["n"], 0
                for x in now.common():
                    x[...] = flat[spot : spot + x.size].reshape(x.shape)
                    spot += x.size
    return now


@dataclass
class Scorer:
    """Tables of the fitted model: pair scores and context normalisers."""

    one: np.ndarray
    two: np.ndarray
    b: np.ndarray
    norm: np.ndarray
    q: np.ndarray
    u: np.ndarray
    v: np.ndarray
    within: np.ndarray

    @staticmethod
    def of(p: Params, sizes: np.ndarray | None = None) -> Scorer:
        one, two = (np.ascontiguousarray((p.r * c) @ p.t.T) for c in p.c)
        norm = np.empty((len(p.b), len(p.b)), np.float32)
        shift = two.max(1)
        e2 = np.exp(two - shift[:, None])
        for w1 in range(0, len(p.b), 64):
            e1 = one[w1 : w1 + 64] + p.b
            top = e1.max(1)
            norm[w1 : w1 + 64] = np.log(np.exp(e1 - top[:, None]) @ e2.T) + top[:, None] + shift
        return Scorer(one, two, p.b, norm, p.q, p.u, p.v, within_norms(p, sizes))

    def log_prob(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of each class in its context."""
        return (self.one[w1, w] + self.two[w2, w] + self.b[w] - self.norm[w1, w2]).astype(np.float64)

    def log_within(self, word: np.ndarray, of: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of words of shared classes among those."""
        row = of - (len(self.b) - len(self.within))
        return ((self.u[word] * self.q[before]).sum(1) + self.v[word] - self.within[row, before]).astype(np.float64)


def within_norms(p: Params, sizes: np.ndarray | None) -> np.ndarray:
    """For each shared class and each class before it, the logarithm of its words' sum.

    ``sizes`` are those of the shared classes, whose words follow one another.
    """
    ends = np.cumsum(sizes) if sizes is not None else []
    out = np.empty((len(ends), len(p.b)), np.float32)
    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True) if len(ends) else []):
        z = p.u[a:b] @ p.q.T + p.v[a:b, None]
        top = z.max(0)
        out[i] = np.log(np.exp(z - top).sum(0)) + top
    return out


SCORED = "doc_id bigint, row string, n_tokens bigint, head_known bigint, head_base double, class_log double, rest array<struct<word:string,n:bigint>>"


def bucket_counts(counts: DataFrame, lookup) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each bucket of unlisted words of ``counts(word, c)``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, edges in block_words(batch.column("word")):
                beyond = lookup.value.index(h) - 1 - lookup.value.size
                rows = np.flatnonzero(beyond >= 0)
                c = batch.column("c").slice(first, len(edges) - 1).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(beyond[rows], pa.int32()), c], names=["bucket", "c"])

    n, v = (np.zeros(lookup.value.buckets) for _ in range(2))
    for r in counts.select("word", "c").mapInArrow(place, "bucket int, c bigint").groupBy("bucket").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["bucket"]], v[r["bucket"]] = r["n"], r["v"]
    return n, v


def score_heads(docs: DataFrame, lookup, log_c: np.ndarray, log_buckets: np.ndarray, scorer: Scorer, words: Vocabulary) -> DataFrame:
    """Per row: what the listed words and the buckets add up to, and all other words.

    ``log_buckets`` is each bucket's sum of smoothed counts.
    """
    log_c, log_buckets, scorer, words = (docs.sparkSession.sparkContext.broadcast(x) for x in (log_c, log_buckets, scorer, words))
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind)
        for batch in batches:
            # a block's rows leave at once, so that no more of its other words are held
            for first, found, data, start, end in encoded(batch.column(1), lookup.value):
                w = words.value.table[found]
                w1, w2 = context(w)
                logs = scorer.value.log_prob(w, w1, w2)
                inside = np.flatnonzero(found >= words.value.own)
                logs[inside] += scorer.value.log_within(found[inside] - words.value.own, w[inside], w1[inside])
                known = found < len(log_c.value)
                gone = np.flatnonzero(~known)
                logs[gone] -= log_buckets.value[found[gone] - len(log_c.value)]
                base = np.append(log_c.value, 0.0)[np.minimum(found, len(log_c.value))]
                edges = np.concatenate(([0], np.flatnonzero(found == 0) + 1))
                # each text ends with its end token, so no segment is empty
                sums = [np.add.reduceat(x, edges[:-1]) for x in (known.astype(np.int64), base, logs)]
                text = data.tobytes()
                cut, rest = np.searchsorted(gone, edges), []
                for i in range(len(edges) - 1):
                    bag = Counter(text[start[j] : end[j]] for j in gone[cut[i] : cut[i + 1]])
                    rest.append([{"word": k.decode("utf-8", "replace"), "n": v} for k, v in bag.items()])
                rows = [f"{task}-{seen + i}" for i in range(len(rest))]
                seen += len(rest)
                cols = (np.diff(edges), *sums, rest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rest)), pa.array(rows, pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.mapInArrow(run, SCORED)


def listed(counts: DataFrame, most: int) -> list:
    """The words ``(word, c)`` over the least count that at most ``most`` words reach.

    Counts are binned by their logarithm, a few hundred bins in all.
    """
    binned = counts.withColumn("bin", F.floor(F.log2("c") * 16))
    sizes = sorted(((r["bin"], r["count"]) for r in binned.groupBy("bin").count().collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    if least is None:
        return []
    return sorted(binned.where(F.col("bin") >= least).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"]))


def lm_scores(docs: DataFrame, m: LogBilinear = LogBilinear()) -> DataFrame:
    """Base and model log10 probabilities of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.where(~held_out(F.col("doc_id"), m.held_out_mod))
    counts = token_counts(training, scratch)
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    ends = counts.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    top = listed(counts.where(F.col("word") != END), m.head)
    c = np.array([ends] + [r["c"] for r in top], np.float64)
    beyond = v - (len(c) if ends else len(c) - 1)
    lookup = docs.sparkSession.sparkContext.broadcast(Lookup([r["word"] for r in top], min(m.buckets, max(1, beyond))))
    bucket_n, bucket_v = bucket_counts(counts.where(F.col("word") != END), lookup)
    vocabulary = Vocabulary.of(c, bucket_n, m)
    start = Params.start(vocabulary.log_noise, m, vocabulary.tail_log)
    fitted = train(training, lookup, start, vocabulary, n, m) if n else start
    log_c = np.log10(c + m.smooth)
    scorer = Scorer.of(fitted, vocabulary.sizes()[vocabulary.own :])
    log_buckets = np.log(bucket_n + m.smooth * (bucket_v + 1))
    scored = scratch.keep(score_heads(docs, lookup, log_c, log_buckets, scorer, vocabulary), "scored")
    rest = scored.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n")
    seen = rest.join(counts, "word").groupBy("row").agg(F.sum("n").alias("rest_known"), F.sum(F.col("n") * (F.log10(F.col("c") + m.smooth) - F.log10(F.lit(m.smooth)))).alias("more"))
    unlisted = F.aggregate("rest", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    # an unlisted word that the corpus lacks has log10(smooth); the join adds the rest
    rest_log = unlisted * float(np.log10(m.smooth)) + F.coalesce("more", F.lit(0.0))
    all_log = float(np.log10(n + m.smooth * (v + 1)))
    return scored.join(seen, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), m.held_out_mod).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + rest_log - F.col("n_tokens") * all_log).alias("base_score"),
        (F.col("class_log") / float(np.log(10)) + rest_log).alias("score"),
    )
