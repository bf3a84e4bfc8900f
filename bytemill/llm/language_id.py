"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Everything is learnt from every training document in one of at most the
``MOST_LANGS`` commonest values of ``lang``, whole: document frequencies from all of
them, the weights from four fifths, the temperature from the other fifth, told apart
by a hash of the text. The four fifths are dealt by hash into blocks of about
``BLOCK``; in each, follow-the-regularised-leader with elastic-net penalties learns
weights of its own, and the weights of all blocks are averaged by their documents.
Scoring is one pass of array lookups.

Rows that may be learnt from have a crc32 of their id with a remainder other
than 2 modulo 4 and a language. A null text or one without a letter is ``und``
with score 0; so is every text if there is nothing to learn from. The model
holds ``2 ** BITS`` weights a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.llm.common import id_remainder, read, unused

BITS = 16
ORDERS = 3
MOST_LANGS = 64
#: Documents of a block, about, and n-grams of documents that a task holds at once (a block of more is cut).
BLOCK, BLOCK_ENTRIES = 2048, 1 << 22
EPOCHS = 2
APART = 5
#: Temperatures that are tried.
HEATS = np.geomspace(0.5, 10, 61)
#: Parts of one in which sums over documents are kept: integers, so that their order is free.
UNIT = 1 << 20
#: FTRL: learning rate, smoothing, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
#: Term frequencies are shares of the text's n-grams, times this.
TF_SCALE = 100.0
#: Characters handled at once, which bounds a task's memory.
CHARS_AT_ONCE = 1 << 18
UNKNOWN = "und"
#: The odd multipliers of the hash, one a place in an n-gram.
_MULTIPLY = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


def _codes(text: str) -> np.ndarray:
    """Code points, lower case, with room after the last for the longest n-gram."""
    return np.frombuffer((text.lower() + "\0" * (ORDERS - 1)).encode("utf-32-le", "replace"), np.uint32)


def _grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the hashed n-gram that starts at each character (not at the room at the end)."""
    n = len(codes) - (ORDERS - 1)
    mixed = np.zeros(n, np.uint32)
    for k in range(ORDERS):
        mixed = (mixed + codes[k : k + n]) * _MULTIPLY[k]
        mixed ^= mixed >> np.uint32(15)
        yield (mixed * _MULTIPLY[4]) >> np.uint32(32 - BITS)


def _slices(codes: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(codes) - (ORDERS - 1), CHARS_AT_ONCE):
        yield codes[at : at + CHARS_AT_ONCE + ORDERS - 1]


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # (2 ** BITS, langs): IDF and temperature are multiplied in
    bias: np.ndarray

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Whole texts in, a row of probabilities for each out."""
        return _softmax(self.logits(texts))

    def logits(self, texts: list[str]) -> np.ndarray:
        sums = np.zeros((len(texts), len(self.langs)))
        codes, sizes, first = [], [], 0
        for i, text in enumerate(texts):
            c = _codes(text)
            codes.append(c)
            sizes.append(len(c))
            if sum(sizes) >= CHARS_AT_ONCE or i == len(texts) - 1:
                if len(codes) == 1:
                    sums[i] = sum(self.weights[g].sum(axis=0, dtype=float) for s in _slices(c) for g in _grams(s))
                else:
                    room = np.zeros(ORDERS - 1, np.uint32)
                    starts = np.cumsum([0, *sizes[:-1]])
                    for g in _grams(np.concatenate([*codes, room])):
                        found = self.weights[g]
                        for end in range(1, ORDERS):  # n-grams that start in the room count for no text
                            found[starts + sizes - end] = 0
                        sums[first : i + 1] += np.add.reduceat(found, starts, axis=0, dtype=float)
                codes, sizes, first = [], [], i + 1
        lengths = np.array([max(1, ORDERS * len(t.lower())) for t in texts])
        return sums * (TF_SCALE / lengths)[:, None] + self.bias


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _has_letter(text: str | None) -> bool:
    import regex

    return bool(text) and regex.search(r"\p{L}", text) is not None


def _training(docs: DataFrame) -> DataFrame:
    return docs.where((id_remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of ``docs`` each hashed n-gram occurs; the last entry is the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                seen = np.zeros(len(counts), bool)
                seen[-1] = True
                for s in _slices(_codes(text)):
                    for g in _grams(s):
                        seen[g] = True
                counts += seen
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["gram", "n"])

    found = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << BITS) + 1, np.int64)
    counts[found["gram"]] = found["n"]
    return counts


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a whole text; the last place is the bias."""
    counts = np.zeros(1 << BITS)
    for s in _slices(_codes(text)):
        counts += np.bincount(np.concatenate(list(_grams(s))), minlength=len(counts))
    at = np.flatnonzero(counts)
    x = counts[at] * idf[at] * TF_SCALE / max(1, ORDERS * len(text.lower()))
    return np.append(at, 1 << BITS).astype(np.int32), np.append(x, 1.0).astype(np.float32)


def _taught(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: int) -> np.ndarray:
    """The weights that follow-the-regularised-leader learns from (places, values, language) in their order."""
    z = np.zeros(((1 << BITS) + 1, langs))
    n = np.zeros_like(z)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            own_z, own_n = z[at], n[at]
            w = weights(own_z, own_n)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = own_n + g * g
            z[at] = own_z + g - (np.sqrt(more) - np.sqrt(own_n)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def _dealt(training: DataFrame, langs: list[str], blocks: int) -> DataFrame:
    """(block, label, text): ``training`` in blocks, in a fixed order."""
    label = F.element_at(F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))]), F.col("lang"))
    rows = training.select(label.alias("label"), "text", F.xxhash64("doc_id", "text").alias("key")).where("label IS NOT NULL")
    tasks = min(blocks, max(4 * training.sparkSession.sparkContext.defaultParallelism, -(-blocks // 4)))
    dealt = rows.withColumn("block", F.pmod("key", F.lit(blocks))).repartition(tasks, "block")
    return dealt.sortWithinPartitions("block", "key", "text", "label").select("block", "label", "text")


def _average(training: DataFrame, langs: list[str], idf: np.ndarray, n: int, size: int) -> np.ndarray:
    """The mean of the weights that blocks of about ``size`` of the ``n`` documents teach."""
    shape = ((1 << BITS) + 1, len(langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, held, last = np.zeros(shape, np.int64), [], 0, None
        for b in batches:
            for block, label, text in zip(*b.columns, strict=True):
                if rows and (block != last or held >= BLOCK_ENTRIES):
                    total += np.rint(_taught(rows, len(langs)) * len(rows) * UNIT).astype(np.int64)
                    rows, held = [], 0
                last = block
                at, x = _features(text.as_py(), idf)
                rows.append((at, x, label.as_py()))
                held += len(at)
        if rows:
            total += np.rint(_taught(rows, len(langs)) * len(rows) * UNIT).astype(np.int64)
        total = total.ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "total"])

    blocks = max(1, round(n / size))
    found = _dealt(training, langs, blocks).mapInArrow(run, "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).toPandas()
    mean = np.zeros(shape[0] * shape[1])
    mean[found["place"]] = found["total"] / (UNIT * n)
    return mean.reshape(shape)


def _heat(training: DataFrame, model: Model) -> float:
    """The temperature that suits ``training`` best."""
    label = {lang: i for i, lang in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(HEATS), np.int64)
        for b in batches:
            rows = [(t, label[y]) for t, y in zip(*(c.to_pylist() for c in b.columns), strict=True) if y in label]
            if rows:
                logits, own = model.logits([t for t, _ in rows]), [y for _, y in rows]
                for k, heat in enumerate(HEATS):
                    loss = -np.log(_softmax(logits / heat)[np.arange(len(own)), own] + 1e-12)
                    total[k] += np.rint(loss * UNIT).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(HEATS)), pa.int32()), pa.array(total)], ["heat", "loss"])

    found = training.select("text", "lang").mapInArrow(run, "heat int, loss long").groupBy("heat").agg(F.sum("loss").alias("loss")).collect()
    return float(HEATS[min(found, key=lambda r: (r["loss"], r["heat"]))["heat"]])


def train(docs: DataFrame, size: int = BLOCK) -> Model | None:
    training = _training(docs)
    apart = F.pmod(F.xxhash64("text"), F.lit(APART)) == 0
    counts = training.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(apart).alias("apart"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return None
    langs, n, kept = sorted(r["lang"] for r in counts), sum(r["n"] for r in counts), sum(r["apart"] for r in counts)
    used = heated = training
    if 0 < kept < n:
        used, heated, n = training.where(~apart), training.where(apart), n - kept
    df = _document_frequencies(training)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    w = _average(used, langs, idf, n, size)
    heat = _heat(heated, Model(langs, (w[:-1] * idf[:, None]).astype(np.float32), w[-1]))
    return Model(langs, (w[:-1] * idf[:, None] / heat).astype(np.float32), w[-1] / heat)


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, lang_pred and score."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if model is not None and _has_letter(t)]
            if some:
                p = model.probabilities([texts[i] for i in some])
                score[some] = p.max(axis=1)
                for i, k in zip(some, p.argmax(axis=1).tolist(), strict=True):
                    lang[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias(unused(keep, "text"))).mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, train(docs), "doc_id")
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is recognised with a score of ``least`` or more; all columns stay."""
    found = predict(docs, train(docs), *docs.columns)
    # the last two columns are the prediction's, whatever the names of the others
    lang, score = unused(docs.columns, "lang_pred"), unused(docs.columns, "score")
    return found.toDF(*docs.columns, lang, score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
