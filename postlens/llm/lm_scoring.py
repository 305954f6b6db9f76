"""Masked pseudo-likelihood: a small network guesses each word from the words on both sides.

Words are named by their 64-bit hash and counted exactly, in a table that has a row per
word. The most frequent words, more of them in a corpus of more words, get a class of their
own and the others a class by hash. The network (embeddings of the window, one hidden layer,
softmax over classes) is trained in numpy by every task on its own rows, on every word of
every document, and the tasks' weights are averaged after each round. A word's conditional probability is that of its class
times its share of the class; a document's score is the sum of their logarithms. Shares are
joined to the words of a run of rows by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Scratch, arrow_schema, only, slices, text_or_empty
from postlens.llm.words import Words, planes, unplanes

#: Classes of a small corpus: 0 is a text's edge, then frequent words, then hashed ones.
CLASSES, FREQUENT = 128, 64
#: From so many different words on, each doubling gives so many frequent words more a class.
GROWS_FROM, MORE_FREQUENT = 1 << 15, 16
SIDE = 2
WIDTH, HIDDEN = 12, 32
#: Each position of a text is trained on in one of the rounds, its neighbours in others.
ROUNDS = 2
BATCH = 512
RATE = 0.05
#: Bytes of text whose different words are counted, or joined to their shares, at once: the
#: more, the fewer rows travel.
COUNTED, SCORED = 4 << 20, 2 << 20
#: Weights travel in so many slices, added up in two steps.
SLICES, FIRST_STEP = 16, 64


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    return {
        "embed": (classes, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "inner0": (HIDDEN,),
        "outer": (HIDDEN, classes), "outer0": (classes,),
    }


SHAPES = shapes(CLASSES)


def initial(classes: int = CLASSES, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.standard_normal(s) * 0.1).ravel() for s in shapes(classes).values()]).astype(np.float32)


def parts(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Views into the weights."""
    out, at = {}, 0
    classes = (len(weights) - 2 * SIDE * WIDTH * HIDDEN - HIDDEN) // (WIDTH + HIDDEN + 1)
    for k, shape in shapes(classes).items():
        n = int(np.prod(shape))
        out[k] = weights[at : at + n].reshape(shape)
        at += n
    return out


def frequent_words(distinct: int) -> int:
    """How many words get a class of their own, of so many different ones."""
    return FREQUENT + MORE_FREQUENT * max(0, (distinct // GROWS_FROM).bit_length() - 1)


class _ByName:
    def __init__(self, find):
        self.find = find

    def __getitem__(self, names: np.ndarray) -> np.ndarray:
        found = self.find(np.atleast_1d(names))
        return found if np.ndim(names) else found[0]


@dataclass
class Vocabulary:
    own: np.ndarray  # names with a class of their own, sorted
    own_class: np.ndarray
    unseen: np.ndarray  # class -> log share of a word that the corpus does not have
    table: DataFrame | None = None  # name, share (its logarithm) of every other word

    @staticmethod
    def of(counts: DataFrame, scratch: Scratch) -> Vocabulary:
        """From ``counts`` (name, n), a row per word."""
        frequent, hashed = frequent_words(counts.count()), CLASSES - FREQUENT - 1
        top = np.array([r["name"] for r in counts.orderBy(F.desc("n"), "name").limit(frequent).collect()], np.int64)
        order = np.argsort(top)
        rest = counts.filter(~F.col("name").isin(top.tolist())) if len(top) else counts
        rest = rest.withColumn("nth", F.pmod("name", F.lit(hashed)).cast("int"))
        # A word that training never met has some share too.
        total = np.ones(hashed)
        for r in rest.groupBy("nth").agg(F.sum(F.col("n") + 1).alias("seen")).collect():
            total[r["nth"]] += r["seen"]
        unseen = np.concatenate([np.zeros(1 + frequent), -np.log(total)])
        table = rest.select("name", (F.log(F.col("n") + 1.0) + _at(-np.log(total), F.col("nth"))).alias("share"))
        return Vocabulary(top[order], 1 + order, unseen, scratch.table(table, "shares"))

    def owned(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a name has a class of its own, where in ``own``)"""
        if not len(self.own):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.own, names), len(self.own) - 1)
        return self.own[at] == names, at

    def class_of(self, names: np.ndarray) -> np.ndarray:
        hashed = CLASSES - FREQUENT - 1
        found, at = self.owned(names)
        out = len(self.unseen) - hashed + names % hashed
        out[found] = self.own_class[at[found]]
        return out

    def share_of(self, names: np.ndarray) -> np.ndarray:
        """Looked up on the driver, for a few names."""
        found, _ = self.owned(names)
        wanted = np.unique(names[~found]).tolist()
        known = {r["name"]: r["share"] for r in self.table.filter(F.col("name").isin(wanted)).collect()} if wanted else {}
        rest = zip(names.tolist(), found, self.unseen[self.class_of(names)])
        return np.array([0.0 if own else known.get(k, least) for k, own, least in rest])

    @property
    def classes(self) -> _ByName:
        return _ByName(self.class_of)

    @property
    def share(self) -> _ByName:
        """Logarithms of names' shares of their classes."""
        return _ByName(self.share_of)


def _at(values: np.ndarray, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)


def names_of(words: Words) -> np.ndarray:
    return words.hash.view(np.int64)


def contexts(words: Words, classes: np.ndarray) -> np.ndarray:
    """For each word the classes of its neighbours, 0 beyond a text's edges."""
    n = len(classes)
    owner = np.repeat(np.arange(len(words)), words.counts())
    out = np.zeros((n, 2 * SIDE), np.int64)
    for k, d in enumerate([d for d in range(-SIDE, SIDE + 1) if d]):
        here = slice(max(0, -d), n - max(0, d))
        there = slice(max(0, d), n + min(0, d))
        out[here, k] = np.where(owner[here] == owner[there], classes[there], 0)
    return out


def forward(w: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.take(w["embed"], context, axis=0).reshape(len(context), -1)
    h = x @ w["inner"]
    h += w["inner0"]
    np.tanh(h, out=h)
    z = h @ w["outer"]
    z += w["outer0"]
    z -= z.max(axis=1, keepdims=True)
    return x, h, z


def log_probability(w: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    _, _, z = forward(w, context)
    picked = z[np.arange(len(target)), target].copy()
    np.exp(z, out=z)
    return picked - np.log(z.sum(axis=1))


def train_batch(w: dict[str, np.ndarray], g2: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> None:
    """One step of AdaGrad, in place."""
    x, h, z = forward(w, context)
    p = np.exp(z, out=z)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(target)), target] -= 1
    p /= len(target)
    dh = (p @ w["outer"].T) * (1 - h * h)
    dx = (dh @ w["inner"].T).reshape(-1, WIDTH)
    flat, classes = context.ravel(), len(w["embed"])
    columns = np.ascontiguousarray(dx.T, np.float64)
    embed = np.stack([np.bincount(flat, column, classes) for column in columns], axis=1).astype(np.float32)
    for k, g in (("outer", h.T @ p), ("outer0", p.sum(axis=0)), ("inner", x.T @ dh), ("inner0", dh.sum(axis=0)), ("embed", embed)):
        square = g * g
        g2[k] += square
        g *= RATE
        g /= np.sqrt(g2[k], out=square)
        w[k] -= g


def corpus_counts(docs: DataFrame) -> DataFrame:
    """name, n: occurrences of each word in all texts."""
    schema = "name bigint, n bigint"
    out = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(batches, most=COUNTED):
            names, n = np.unique(names_of(Words(run.column("text"), lower=True)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64())], schema=out)

    return docs.select("text").mapInArrow(count, schema).groupBy("name").agg(F.sum("n").alias("n"))


def turn(words: Words, phase: int) -> np.ndarray:
    """Words that a round trains on, by their place in their own text, so that the order of
    the texts does not matter."""
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts())
    return np.flatnonzero(place % ROUNDS == phase)


def train_round(docs: DataFrame, vocabulary, weights: np.ndarray, phase: int) -> np.ndarray:
    """Each task trains a copy of the weights on its rows; their mean by trained words."""
    schema = "slice int, step int, trained double, weights array<float>"
    out = arrow_schema(schema)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weights.copy()
        w = parts(own)
        g2 = {k: np.full_like(v, 1e-6) for k, v in w.items()}
        trained = 0
        for run in slices(batches):
            words = Words(run.column("text"), lower=True)
            classes = vocabulary.value.classes[names_of(words)]
            chosen = turn(words, phase)
            around = contexts(words, classes)[chosen]
            target = classes[chosen]
            for a in range(0, len(target), BATCH):
                train_batch(w, g2, around[a : a + BATCH], target[a : a + BATCH])
            trained += len(target)
        if trained:
            step = TaskContext.get().partitionId() % FIRST_STEP
            cut = np.array_split(own * np.float32(trained), SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([step] * SLICES, pa.int32()),
                 pa.array([float(trained)] * SLICES), pa.array([c.tolist() for c in cut], pa.list_(pa.float32()))],
                schema=out,
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.array(x, np.float64) for x in table.column("weights").to_pylist()], axis=0)
        return pa.table(
            [pa.array([table.column("slice")[0].as_py()], pa.int32()), pa.array([table.column("step")[0].as_py()], pa.int32()),
             pa.array([sum(table.column("trained").to_pylist())]), pa.array([total.tolist()], pa.list_(pa.float32()))], schema=out,
        )

    sums = docs.select("text").mapInArrow(train, schema).groupBy("slice", "step").applyInArrow(add, schema)
    found = sorted(sums.groupBy("slice").applyInArrow(add, schema).collect(), key=lambda r: r["slice"])
    if not found:
        return weights
    return np.concatenate([np.array(r["weights"], np.float64) / r["trained"] for r in found]).astype(np.float32)


def fit(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    read = only(docs, "text").select(text_or_empty().alias("text"))
    scratch = Scratch(docs.sparkSession, "likelihood")
    vocabulary = Vocabulary.of(scratch.table(corpus_counts(read), "words"), scratch)
    scratch.drop("words")
    shared = docs.sparkSession.sparkContext.broadcast(replace(vocabulary, table=None))
    weights = initial(len(vocabulary.unseen))
    for phase in range(ROUNDS):
        weights = train_round(read, shared, weights, phase)
    return vocabulary, weights


def class_logs(words: Words, classes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each word the log-probability of its class."""
    logs = np.zeros(len(classes))
    around, w = contexts(words, classes), parts(weights)
    for a in range(0, len(classes), 2048):
        part = slice(a, a + 2048)
        logs[part] = log_probability(w, around[part], classes[part])
    return logs


def text_sums(logs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of ``logs``, one from each ``first`` to the next."""
    total = np.concatenate([[0.0], np.cumsum(logs)])
    return total[first[1:]] - total[first[:-1]]


def score_texts(texts: pa.Array, vocabulary: Vocabulary, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed log-probability) of each text, for a few texts on the driver."""
    words = Words(texts, lower=True)
    names = names_of(words)
    logs = class_logs(words, vocabulary.classes[names], weights) + vocabulary.share[names]
    return words.counts(), text_sums(logs, words.first)


def pseudo_likelihood(docs: DataFrame, model: tuple[Vocabulary, np.ndarray] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, sum_log_probability, mean_log_probability.

    Null text and text without words have sum 0 and a null mean. Equal texts have equal
    scores, up to rounding. Null doc_ids and repeated rows have rows of their own. An empty
    table gives no rows. Other columns are not read.
    """
    vocabulary, weights = model or fit(docs)
    scratch = Scratch(docs.sparkSession, "likelihood")
    shared = docs.sparkSession.sparkContext.broadcast((replace(vocabulary, table=None), weights))
    read = only(docs, "doc_id", "text").withColumn("text", text_or_empty())
    id_type = dict(read.dtypes)["doc_id"]
    # A run of rows is one row. ``rare`` has its different words without a class of their
    # own, ``at`` their place in ``rare`` for each occurrence, ``n_rare`` a text's occurrences.
    schema = (
        f"run bigint, doc_id array<{id_type}>, n_words array<bigint>, logs array<double>, "
        "n_rare array<bigint>, rare array<bigint>, at binary"
    )
    out = arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, learned = shared.value
        task = TaskContext.get().partitionId()
        for k, run in enumerate(slices(batches, most=SCORED)):
            words = Words(run.column("text"), lower=True)
            names = names_of(words)
            seldom = ~known.owned(names)[0]
            rare, at = np.unique(names[seldom], return_inverse=True)
            before = np.concatenate([[0], np.cumsum(seldom)])[words.first]
            lists = [
                run.column("doc_id"), pa.array(words.counts(), pa.int64()),
                pa.array(text_sums(class_logs(words, known.classes[names], learned), words.first)),
                pa.array(np.diff(before), pa.int64()), pa.array(rare),
            ]
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | k]), *lists, pa.array([planes(at.astype(np.uint32))], pa.binary())], schema=out
            )

    runs = scratch.table(read.mapInArrow(score, schema), "runs")
    unseen = vocabulary.unseen[-(CLASSES - FREQUENT - 1) :]
    least = _at(unseen, F.pmod("name", F.lit(len(unseen))).cast("int"))
    wanted = runs.select(F.col("run").alias("of"), F.posexplode("rare").alias("place", "name"))
    shares = wanted.join(vocabulary.table, "name", "left").select("of", "place", F.coalesce("share", least).alias("share"))
    result = f"doc_id {id_type}, n_words bigint, sum_log_probability double"
    columns = arrow_schema(result)

    def total(run: pa.Table, found: pa.Table) -> pa.Table:
        share = np.zeros(found.num_rows)
        share[found.column("place").to_numpy()] = found.column("share").to_numpy()
        doc_id, n, logs, n_rare = (run.column(c).combine_chunks().flatten() for c in ("doc_id", "n_words", "logs", "n_rare"))
        first = np.concatenate([[0], np.cumsum(n_rare.to_numpy())])
        logs = logs.to_numpy() + text_sums(share[unplanes(run.column("at")[0].as_py(), np.uint32)], first)
        return pa.table([doc_id, n, pa.array(logs)], schema=columns)

    mean = F.when(F.col("n_words") > 0, F.col("sum_log_probability") / F.col("n_words"))
    scored = runs.drop("rare").groupBy("run").cogroup(shares.groupBy("of")).applyInArrow(total, result)
    return scored.withColumn("mean_log_probability", mean)
