"""Mixing towards target weights by soft domain membership.

A softmax classifier over relative word frequencies, fitted on a bounded sample of the labelled table,
gives every document a posterior over domains. Nonnegative rates (expected copies of a document) are
then fitted by projected-gradient least squares, so that expected domain token totals meet their
targets. A gradient step subtracts p . v from every rate, with p the document's posterior and v one
vector for all, so a rate follows from its posterior, its start and the list of steps: the state of an
iteration is a few numbers, and each iteration is one aggregation over a staged table of posteriors.

The start comes from a coarse level. One pass sums tokens up by cells of the posterior, a bounded number, and the
same squares are solved over one rate a cell. Token totals are linear in the rates, so a cell's rate means the same
for its documents as for the cell, and targets within reach are met there already; targets out of reach, for
which plain steps take thousands of rounds, leave a few steps to the documents.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_column, documents, slices, staged, worker_table
from tidemark.llm.token_counts import _processor, pre_tokens

#: Labelled rows that the classifier is fitted on (expected number; a hash of the id chooses).
TRAIN_ROWS = 3000
FEATURES = 1 << 15
SCALE = 40.0
WORD_CACHE = 500_000
#: Share of the kept tokens that each domain is to have.
TARGETS = {"good": 0.60, "plain": 0.37, "toxic": 0.03}
#: The steps over documents end when no domain misses its target by more than this share of all tokens, when three in
#: a row change no total by more than a tenth of it, or after so many; the miss, and whether they ended by themselves, are returned.
TOLERANCE, STEPS = 1e-6, 60
#: Cells of the posterior at most, and rounds of the coarse fit at most.
CELLS, COARSE_ROUNDS = 20_000, 20_000


class WordFeatures(dict):
    """Lower-cased word to its feature number, bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word) % FEATURES
        if len(word) <= 64:
            self[word] = value
        return value


def features(texts: list[bytes], table: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, text after text, and the number of words of each text."""
    words = [x.lower().split() for x in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    return np.fromiter(map(table.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(n.sum())), n


#: In the code of a pre-token: no word in it. Its feature is below, its tokens above.
_BARE, _SHIFT = FEATURES, 16
#: Stands for the code of a pre-token that the table lacks.
_NEW = -2


class Codes(dict):
    """Pre-token to its tokens and the feature of its word in one number, -1 where it has several words; bounded in size."""

    def __init__(self, path: str):
        super().__init__()
        self.encode, self.words = _processor(path).encode, WordFeatures()

    def tokens(self, keys: list[bytes]) -> list[int]:
        """Tokens of each pre-token; the empty one is a mark alone."""
        return [len(x) or 1 for x in self.encode([k.decode("utf-8") for k in keys], num_threads=1)] if keys else []

    def learned(self, keys: list[bytes]) -> dict[bytes, int]:
        """Codes of ``keys``, which the table lacks: encoded in one call, and remembered within the bound."""
        fresh = {}
        for key, n in zip(keys, self.tokens(keys), strict=True):
            own = key.lower().split()
            fresh[key] = -1 if len(own) > 1 else n << _SHIFT | (xxhash.xxh3_64_intdigest(own[0]) % FEATURES if own else _BARE)
        if len(self) + len(fresh) > WORD_CACHE:
            self.clear()
        self.update((k, v) for k, v in fresh.items() if len(k) <= 64)
        return fresh


def described(texts: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all words, text after text, and the words and the tokens of each text, with one lookup a pre-token."""
    parts = [pre_tokens(x) for x in texts]
    keys = list(chain.from_iterable(parts))
    code = np.fromiter(map(codes.get, keys, repeat(_NEW)), dtype=np.int64, count=len(keys))
    new = np.flatnonzero(code == _NEW).tolist()
    if new:
        own = [keys[i] for i in new]
        fresh = codes.learned(list(set(own)))
        code[new] = [fresh[k] for k in own]
    tokens, width = code >> _SHIFT, ((code & _BARE) == 0).astype(np.int64)
    several = np.flatnonzero(code < 0)
    found = [[codes.words[w] for w in keys[i].lower().split()] for i in several.tolist()]
    tokens[several], width[several] = codes.tokens([keys[i] for i in several.tolist()]), [len(x) for x in found]
    at = np.cumsum(width) - width
    flat = np.zeros(int(width.sum()), dtype=np.int64)
    one = (code >= 0) & (width == 1)
    flat[at[one]] = code[one] & (FEATURES - 1)
    for i, x in zip(at[several].tolist(), found, strict=True):
        flat[i : i + len(x)] = x
    ends = np.cumsum([len(x) for x in parts]).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    upto = lambda x: np.concatenate(([0], np.cumsum(x)))
    return flat, upto(width)[ends] - upto(width)[starts], upto(tokens)[ends] - upto(tokens)[starts]


class SoftClassifier:
    """Softmax regression on relative word frequencies."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.weights = np.zeros((FEATURES, len(domains)))
        self.bias = np.zeros(len(domains))

    def posteriors(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        total = np.zeros((len(n), len(self.domains)))
        some = n > 0
        if some.any():
            starts = (np.cumsum(n) - n)[some]
            total[some] = np.add.reduceat(self.weights[flat], starts, axis=0) * (SCALE / n[some])[:, None]
        z = total + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, texts: list[bytes], labels: np.ndarray, rounds: int = 60, rate: float = 0.05, decay: float = 1e-4) -> SoftClassifier:
        flat, n = features(texts, WordFeatures())
        owner = np.repeat(np.arange(len(n)), n)
        k = len(self.domains)
        truth = np.eye(k)[labels]
        self.bias = np.log((truth.sum(axis=0) + 1) / (len(truth) + k))
        m, v, weight = np.zeros_like(self.weights), np.zeros_like(self.weights), SCALE / np.maximum(n, 1)
        for i in range(1, rounds + 1):  # Adam on the whole sample
            error = (self.posteriors(flat, n) - truth) / len(n)
            step = error * weight[:, None]
            slope = np.stack([np.bincount(flat, step[owner, c], minlength=FEATURES) for c in range(k)], axis=1) + decay * self.weights / len(n)
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            self.weights -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
        return self


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> SoftClassifier:
    """``labelled`` has (id, domain); rows with a null or unknown domain, or an id that ``docs`` lacks, do not count."""
    known = labelled.where(F.col("id").isNotNull() & F.col("domain").isin(domains))
    size = known.count()
    unit = F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    chosen = known.where(unit < F.lit(min(1.0, train_rows / max(size, 1)))).orderBy(unit, "id", "domain").limit(2 * train_rows)
    # the sample is bounded by its parameter, so it may be broadcast
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "domain").toArrow().sort_by([("id", "ascending"), ("domain", "ascending")])
    model = SoftClassifier(domains)
    if got.num_rows:
        model.fit(byte_column(got["text"].combine_chunks()), np.array([domains.index(x) for x in got["domain"].to_pylist()]))
    return model


def posterior_table(docs: DataFrame, model: SoftClassifier, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens (of the sentencepiece model at ``model_path``), posterior (in the order of the model's domains)."""
    k = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = worker_table(Codes, model_path)
        for batch in batches:
            texts = byte_column(batch.column(1))
            for lo, hi in slices([len(x) for x in texts]):
                flat, words, tokens = described(texts[lo:hi], codes)
                p = model.posteriors(flat, words)
                offsets = pa.array(np.arange(0, (hi - lo) * k + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(tokens), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names=[id_col, "n_tokens", "posterior"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` bigint, n_tokens bigint, posterior array<double>")


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


class Start(NamedTuple):
    """Rates to start from: one for each cell, a cell being the rounded multiples of 1 / ``grid`` of all posteriors but the last."""

    grid: int
    cells: np.ndarray
    rates: np.ndarray

    def of(self, p: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.ones(len(p))
        return self.rates[np.minimum(np.searchsorted(self.cells, cell(p, self.grid)), len(self.cells) - 1)]


def cell(p: np.ndarray, grid: int) -> np.ndarray:
    out = np.zeros(len(p), dtype=np.int64)
    for i in range(p.shape[1] - 1):
        out = out * (grid + 1) + np.rint(p[:, i] * grid).astype(np.int64)
    return out


def grid_of(k: int) -> int:
    """The finest grid whose cells stay within ``CELLS``: rounded posteriors sum to the grid, give or take the rounding."""
    grid = 1
    while math.comb(2 * grid + 2 * (k - 1), k - 1) <= CELLS and grid < 1024:
        grid *= 2
    return grid


Step = tuple[np.ndarray, float]


def replay(p: np.ndarray, steps: list[Step], start: np.ndarray, cap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rates after ``steps``, the extrapolated point at which the next gradient is taken, and rates and point of one step before."""
    rate = point = last_rate = last_point = start
    for vector, push in steps:
        last_rate, last_point = rate, point
        new = np.clip(point - p @ vector, 0.0, cap)
        point, rate = new + push * (new - rate), new
    return rate, point, last_rate, last_point


class Fit(NamedTuple):
    """Start and steps of the gradient, what each domain's expected tokens miss of its target as a share of all tokens, and whether the steps ended by themselves."""

    start: Start
    steps: list[Step]
    miss: np.ndarray
    settled: bool
    cap: float

    def rates(self, p: np.ndarray) -> np.ndarray:
        return replay(p, self.steps, self.start.of(p), self.cap)[0]


Targets = dict[str, float] | Callable[[dict[str, float]], dict[str, float]]


def solve_cells(share_of: np.ndarray, p: np.ndarray, weigh: np.ndarray, wanted: np.ndarray, cap: float) -> np.ndarray:
    """One rate a cell, from cells' shares of all tokens and their mean posteriors: accelerated projected gradient, restarted where it turns."""
    rate = point = np.ones(len(p))
    flow = share_of[:, None] * p
    momentum, cost, since = 1.0, np.inf, 0
    for n in range(COARSE_ROUNDS):
        new = np.clip(point - p @ (weigh @ (flow.T @ point - wanted)), 0.0, cap)
        turned = share_of @ ((point - new) * (new - rate)) > 0
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push, momentum = (0.0, 1.0) if turned else ((momentum - 1) / later, later)
        point, rate = new + push * (new - rate), new
        if n % 100 == 99:
            miss = flow.T @ rate - wanted
            now = float(miss @ weigh @ miss)
            since = since + 1 if now > cost * (1 - 1e-4) else 0
            cost = min(cost, now)
            if now < TOLERANCE**2 / 100 or since >= 3:
                break
    return rate


def fit_rates(table: DataFrame, domains: list[str], targets: Targets, cap: float = np.inf) -> Fit:
    """Accelerated projected gradient for rates in [0, ``cap``] with sum(rate * tokens * posterior) = target * all tokens.

    The squares are weighted by the inverse of the domains' Gram matrix, which makes the largest
    curvature 1: the step needs no search, and domains of few tokens are met as fast as large ones.
    """
    k, grid = len(domains), grid_of(len(domains))

    def summed(run, columns: str) -> list:
        names = [c.split()[0] for c in columns.split(", ")]
        keys = names[:-1]
        return table.select("n_tokens", "posterior").mapInArrow(run, columns).groupBy(*keys).agg(F.sum("x").alias("x")).orderBy(*keys).collect()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((k, k))
        for batch in batches:
            p, t = _matrix(batch.column(1), k), batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            gram += (p * t[:, None]).T @ p
            own, at = np.unique(cell(p, grid), return_inverse=True)
            for i, x in enumerate((t, *(p * t[:, None]).T)):
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), i)), pa.array(np.bincount(at, x, minlength=len(own)))], names=["c", "i", "x"])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k * k, -1)), pa.array(np.arange(k * k)), pa.array(gram.ravel())], names=["c", "i", "x"])

    rows = summed(cells, "c bigint, i bigint, x double")  # CELLS cells at most
    gram = np.array([r.x for r in rows if r.c < 0])
    level = np.array([r.x for r in rows if r.c >= 0]).reshape(-1, k + 1)
    numbers = np.array(sorted({r.c for r in rows if r.c >= 0}), dtype=np.int64)
    all_tokens = float(level[:, 0].sum()) if len(level) else 0.0
    ones = Start(grid, numbers, np.ones(len(numbers)))
    if not all_tokens:
        return Fit(ones, [], np.zeros(k), True, cap)
    supply = level[:, 1:].sum(axis=0) / all_tokens
    wanted = targets(dict(zip(domains, supply.tolist(), strict=True))) if callable(targets) else targets
    share = np.array([wanted[d] for d in domains], dtype=float)
    share = share if callable(targets) else share / share.sum()
    weigh = np.linalg.pinv(gram.reshape(k, k) / all_tokens, rcond=1e-9, hermitian=True)
    coarse = solve_cells(level[:, 0] / all_tokens, level[:, 1:] / np.maximum(level[:, :1], 1e-300), weigh, share, cap)
    start = Start(grid, numbers, coarse)

    def totals(steps: list[Step]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(2 * k + 1)
            for batch in batches:
                p, t = _matrix(batch.column(1), k), batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                rate, point, last_rate, last_point = replay(p, steps, start.of(p), cap)
                out += np.concatenate((p.T @ (t * rate), p.T @ (t * point), [t @ ((last_point - rate) * (rate - last_rate))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "x"])

        return np.array([r.x for r in summed(run, "i bigint, x double")]) / all_tokens

    steps: list[Step] = []
    at_rate = at_point = (level[:, 1:] * coarse[:, None]).sum(axis=0) / all_tokens
    momentum, still = 1.0, 0
    while np.abs(at_rate - share).max() > TOLERANCE and still < 3 and len(steps) < STEPS:
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        steps.append((weigh @ (at_point - share), float((momentum - 1) / later)))
        before, both = at_rate, totals(steps)
        at_rate, at_point, momentum = both[:k], both[k : 2 * k], later
        if both[-1] > 0:  # it turns: go on without momentum from where the rates are
            steps[-1] = (steps[-1][0], 0.0)
            at_point, momentum = at_rate, 1.0
        still = still + 1 if np.abs(at_rate - before).max() < TOLERANCE / 10 else 0
    settled = bool(still >= 3 or np.abs(at_rate - share).max() <= TOLERANCE)
    if not settled:
        warnings.warn(f"the rates still move after {STEPS} steps over all documents; the worst domain misses {np.abs(at_rate - share).max():.2g} of all tokens", stacklevel=2)
    return Fit(start, steps, at_rate - share, settled, cap)


def mix(docs: DataFrame, labelled: DataFrame, model_path: str, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text", cap: float = np.inf) -> DataFrame:
    """Per row: id, n_tokens, rate (expected copies, ``cap`` at most), p_<domain> for each domain, ``miss`` and ``settled``.

    Tokens are those of the sentencepiece model at ``model_path``. ``targets`` are nonnegative shares of the
    tokens, scaled to sum to one, so the total stays that of the input; or a function from each domain's share
    of the input's tokens to the share wanted, in the same unit, unscaled. Targets that no nonnegative rates
    reach are approached in least squares; ``miss``, the same in all rows, is what the worst domain misses, as
    a share of all tokens, and ``settled`` says whether the fit had come to rest. Null and empty texts have no tokens and the prior as posterior; very long texts
    count whole. Repeated rows get a rate each, ties do not arise. Without labels all posteriors are equal and
    all rates too. Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    targets = targets or TARGETS
    domains = sorted(TARGETS if callable(targets) else targets)
    model = fit_classifier(docs, labelled, domains, id_col, text_col)
    table = staged(posterior_table(docs, model, model_path, id_col, text_col), "posteriors")
    fit = fit_rates(table, domains, targets, cap)
    k, worst = len(domains), float(np.abs(fit.miss).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column(2), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fit.rates(p)), *[pa.array(p[:, i]) for i in range(k)], pa.array(np.full(len(p), worst)), pa.array(np.full(len(p), fit.settled))], names=[id_col, "n_tokens", "rate", *[f"p_{d}" for d in domains], "miss", "settled"])

    return table.select(id_col, "n_tokens", "posterior").mapInArrow(run, f"`{id_col}` bigint, n_tokens bigint, rate double, " + ", ".join(f"`p_{d}` double" for d in domains) + ", miss double, settled boolean")


def thinned(domain: str, share: float) -> Targets:
    """Targets that leave every domain its tokens but for ``domain``, which keeps ``share`` of its own at most."""
    return lambda supply: {d: x * share if d == domain else x for d, x in supply.items()}


def mixed(docs: DataFrame, labelled: DataFrame, model_path: str, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text", cap: float = np.inf) -> DataFrame:
    """Rows of ``docs`` as often as their rate says: its whole part, and once more with the rest as probability.

    With a ``cap`` of 1 no row is there more often than before. Ties do not arise; a fit that has not come to rest
    warns. The draw is a hash of the id and the text, so a rerun gives the same rows. A row takes its rate along as it is read:
    nothing is joined, so rows with a null or a repeated id are treated like others, and columns keep their
    names and order. For null, empty and very long texts and empty tables see :func:`mix`.
    """
    targets = targets or TARGETS
    domains = sorted(TARGETS if callable(targets) else targets)
    model = fit_classifier(docs, labelled, domains, id_col, text_col)
    fit = fit_rates(staged(posterior_table(docs, model, model_path, id_col, text_col), "posteriors"), domains, targets, cap)
    fields = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = worker_table(Codes, model_path)
        for batch in batches:
            ids, texts = batch.column(fields.index(id_col)).to_pylist(), byte_column(batch.column(fields.index(text_col)))
            for lo, hi in slices([len(x) for x in texts]):
                rate = fit.rates(model.posteriors(*described(texts[lo:hi], codes)[:2]))
                unit = np.array([xxhash.xxh3_64_intdigest(f"mix {i} ".encode() + x) for i, x in zip(ids[lo:hi], texts[lo:hi], strict=True)], dtype=np.uint64) / 2.0**64
                yield batch.slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), np.floor(rate + unit).astype(np.int64))))

    return docs.mapInArrow(run, docs.schema)


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain) from the labels table: toxic, else good or plain by quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return mix(documents(spark, sf_dir), domain_labels(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
