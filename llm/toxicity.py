"""A convolutional text classifier for toxicity, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first six and four bytes, so
inflected forms share what they have in common. Filters of one, two and three words run over the
whole text; each filter's largest answer goes into a logistic layer. Training uses a bounded sample
of labelled rows (TRAIN_CLEAN and TRAIN_TOXIC documents, half of TRAIN_WORDS words for each kind); a text that
does not fit is skipped, and texts above a hundredth of the words of their kind come last. Scoring reads
every document whole, in tasks, with the model as a broadcast of fixed size.

Thresholds are calibrated by language on all labelled rows that are not held out: three fold models, each
trained without the sample rows of its fold, score the rows of their fold, and the thresholds come from counts of
logits in cells of 1 / CELLS. A score never reads the language column: the language is guessed from the words
(naive Bayes on the same hashes); every language of the documents has a profile.
The score is shifted by its language's threshold, so DECISION separates the classes in every language.

Null texts are empty; an empty text gets the score of a text without any word. Without labels of both
kinds every score is 0; if they exist but the sample holds only one, an error is raised.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import written
from llm.words import SPACE, Words, slices

BUCKETS, DIMENSIONS, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
PREFIXES = (6, 4)
TRAIN_CLEAN, TRAIN_TOXIC, TRAIN_WORDS = 4000, 2000, 4_000_000
LONG_SHARE = 100
STEPS, BATCH, RATE, FOLDS, LEAST_TEXTS = 1000, 32, 0.1, 3, 3
DECISION = 0.3
SLICE = 1 << 20
# Languages are compared so many at a time; each is learnt from the sample and from a few texts of its own.
LANGUAGES, LANGUAGE_TEXTS, LANGUAGE_WORDS = 16, 20, 2000
CELLS, FARTHEST = 64, 32

BETWEEN = SPACE.copy()
BETWEEN[[c for c in range(128) if not chr(c).isalnum()]] = True
HASHES = 1 + len(PREFIXES)


def word_ids(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, a row per word with a column per hash, and the words' row bounds."""
    words = Words(raw, offsets, BETWEEN)
    ids = np.stack([(h >> np.uint64(20)) % np.uint64(BUCKETS) for h in words.hashes(True, PREFIXES)], axis=1)
    return ids.astype(np.int32), words.first


class Model:
    """Weights; row BUCKETS of the embedding stays zero and pads the texts."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.embedding = (r.normal(0, 0.01, (BUCKETS + 1, DIMENSIONS))).astype(np.float32)
        self.embedding[BUCKETS] = 0
        self.filters = [r.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.offsets = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-1)
        self.languages: list[str] = []
        self.by_word = np.zeros((BUCKETS, 1), np.float32)
        self.thresholds = np.zeros(1, np.float32)

    def pooled(self, ids: np.ndarray, first: np.ndarray, places: bool = False):
        """The largest answer of each filter in each text; with `places`, also where it stood and the input."""
        rows, extra = len(first) - 1, max(WIDTHS) - 1
        begin = first[:-1] - first[0] + extra * np.arange(rows)
        size = np.diff(first) + extra
        padded = np.full((int(size.sum()) + extra, HASHES), BUCKETS, np.int32)
        at = np.arange(len(ids)) + extra * np.repeat(np.arange(rows), np.diff(first))
        padded[at] = ids
        x = self.embedding[padded].sum(axis=1)
        answers, where = [], []
        for f, b in zip(self.filters, self.offsets, strict=True):
            n = len(x) - extra
            y = sum(x[o:o + n] @ f[o] for o in range(len(f))) + b
            for k in range(len(f) - 1):
                y[begin + size - 1 - k] = -np.inf
            answers.append(np.maximum.reduceat(y, begin, axis=0))
            if places:
                where.append(np.stack([s + y[s:s + n].argmax(axis=0) for s, n in zip(begin, size, strict=True)]))
        return np.concatenate(answers, axis=1), where, padded, x

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        top = np.maximum(self.pooled(ids, first)[0], 0)
        return top @ self.out + self.bias

    def language(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The guessed language of each text, as a row of `thresholds`."""
        rows = np.arange(len(first) - 1)
        best, found = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
        for k in range(0, self.by_word.shape[1], LANGUAGES):
            some = self.by_word[:, k:k + LANGUAGES]
            total = np.zeros((len(ids) + 1, some.shape[1]))
            np.cumsum(some[ids[:, 0]], axis=0, out=total[1:])
            mine = total[first[1:]] - total[first[:-1]]
            top = mine.argmax(axis=1)
            better = mine[rows, top] > best
            best[better], found[better] = mine[rows, top][better], k + top[better]
        return found

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        shifted = self.logits(ids, first) - self.thresholds[self.language(ids, first)]
        shifted = np.clip(shifted.astype(np.float64), -30, 30) + np.log(DECISION / (1 - DECISION))
        return 1 / (1 + np.exp(-shifted))


def train(model: Model, texts: list[np.ndarray], toxic: np.ndarray, steps: int = STEPS, seed: int = 6) -> None:
    """Adagrad on the weighted logistic loss; only the words that gave a filter's largest answer learn."""
    r = np.random.default_rng(seed)
    dense = [*model.filters, *model.offsets, model.out]
    seen = [np.full_like(p, 1e-3) for p in dense]
    seen_words = np.full(BUCKETS + 1, 1e-3, np.float32)
    weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum())) * len(toxic)
    for _ in range(-(-steps * BATCH // len(texts))):
        order = r.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            some = order[k:k + BATCH]
            ids, first = joined([texts[i] for i in some])
            raw, where, padded, x = model.pooled(ids, first, places=True)
            top = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(top @ model.out + model.bias, -30, 30)))
            slope = ((p - toxic[some]) * weight[some] / len(some)).astype(np.float32)
            back = np.outer(slope, model.out) * (raw > 0)
            slopes = [*(np.zeros_like(f) for f in model.filters), *(np.zeros_like(b) for b in model.offsets),
                      slope @ top]
            words, moves = [], []
            for i, f in enumerate(model.filters):
                g = back[:, i * FILTERS:(i + 1) * FILTERS]
                slopes[len(WIDTHS) + i] = g.sum(axis=0)
                for o in range(len(f)):
                    at = where[i] + o
                    slopes[i][o] = np.einsum("bf,bfd->df", g, x[at])
                    words.append(padded[at].reshape(-1, HASHES))
                    moves.append((g[:, :, None] * f[o].T[None]).reshape(-1, DIMENSIONS))
            for value, step, past in zip(dense, slopes, seen, strict=True):
                past += step * step
                value -= RATE * step / np.sqrt(past)
            model.bias -= np.float32(RATE * slope.sum())
            words, moves = np.concatenate(words), np.concatenate(moves)
            touched, back_to = np.unique(words, return_inverse=True)
            step = np.zeros((len(touched), DIMENSIONS), np.float32)
            for c in range(HASHES):
                np.add.at(step, back_to.reshape(words.shape)[:, c], moves)
            seen_words[touched] += (step * step).mean(axis=1)
            model.embedding[touched] -= RATE * step / np.sqrt(seen_words[touched])[:, None]
            model.embedding[BUCKETS] = 0


def best_threshold(cells: dict[int, list[int]]) -> float:
    """The middle of the gap at which the F1 measure is best; `cells` holds clean and toxic counts of cells of logits."""
    at = np.array(sorted(cells, reverse=True))
    clean, toxic = np.array([cells[c] for c in at.tolist()], np.float64).T
    hits = np.cumsum(toxic)
    k = int(np.argmax(2 * hits / (hits + np.cumsum(clean) + toxic.sum())))
    return float(at[k] + (at[k + 1] + 1 if k + 1 < len(at) else at[k] - 2 * CELLS)) / 2 / CELLS


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts), np.cumsum([0, *map(len, texts)])


def calibrate(model: Model, counts: list, least: int = 20) -> None:
    """A threshold for each guessed language from counts (language, cell, toxic, n); with few cases of a kind the common one."""
    every: dict[int, list[int]] = {}
    by_language: dict[int, dict[int, list[int]]] = {}
    for language, cell, toxic, n in counts:
        for cells in (every, by_language.setdefault(language, {})):
            cells.setdefault(cell, [0, 0])[toxic] += n

    def fewest(cells):
        return min((sum(c[k] for c in cells.values()) for k in (0, 1)), default=0)
    common = best_threshold(every) if fewest(every) else 0.0
    for k in range(len(model.thresholds)):
        cells = by_language.get(k, {})
        model.thresholds[k] = best_threshold(cells) if fewest(cells) >= least else common


def learn_languages(model: Model, texts: list[np.ndarray], names: list[str | None]) -> None:
    """Word log-likelihoods of all languages of the texts, the commonest first."""
    known, counts = np.unique([n for n in names if n] or ["?"], return_counts=True)
    model.languages = known[np.argsort(-counts, kind="stable")].tolist()
    seen = np.full((BUCKETS, len(model.languages)), 0.1, np.float32)
    number = {name: k for k, name in enumerate(model.languages)}
    for ids, name in zip(texts, names, strict=True):
        if name in number:
            np.add.at(seen[:, number[name]], ids[:, 0], 1)
    model.by_word = np.log(seen / seen.sum(axis=0, dtype=np.float64)).astype(np.float32)
    model.thresholds = np.zeros(len(model.languages), np.float32)


def held_out(doc_id) -> F.Column:
    """Rows no label may be learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def rank() -> F.Column:
    """The order of the sample; its remainder is the fold."""
    return F.xxhash64(F.lit(11), F.col("doc_id"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in slices(batch.column("text"), SLICE):
            ids, first = word_ids(raw, offsets)
            learnt = batch.column("toxic").slice(a, b - a).is_valid().to_pylist()
            out = [ids[first[i]:first[i + 1]][:None if learnt[i] else LANGUAGE_WORDS].astype(np.uint16).tobytes()
                   for i in range(b - a)]
            yield pa.record_batch([batch.column("rank").slice(a, b - a), batch.column("lang").slice(a, b - a),
                                   batch.column("toxic").slice(a, b - a), pa.array(out, pa.binary()),
                                   pa.array(np.diff(first))], ["rank", "lang", "toxic", "ids", "words"])


def within_budget(rows: list, most: int, words: int) -> list[int]:
    """Numbers `at` of rows (rank, order, words, at) taken in order of rank; a text that does not fit is skipped.

    Texts above a LONG_SHARE of the words come after all others, with what is left.
    """
    chosen, left = [], words
    for r in sorted(rows, key=lambda r: (r["words"] * LONG_SHARE > words, r["rank"], r["order"])):
        if len(chosen) < most and r["words"] <= left:
            chosen.append(r["at"])
            left -= r["words"]
    return chosen


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that may be learnt from."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()


def training_rows(docs: DataFrame, labels: DataFrame, clean: int = TRAIN_CLEAN, toxic: int = TRAIN_TOXIC,
                  words: int = TRAIN_WORDS) -> DataFrame:
    """The bounded sample, chosen by the ids and the numbers of words: rank, lang, toxic, ids. Each kind has half the words.

    Rows without `toxic` are the first texts of each language, for its profile only.
    """
    usable = labelled(labels).withColumn("rank", rank())
    some = usable.filter("toxic = 1").orderBy("rank").limit(toxic).unionAll(
        usable.filter("toxic = 0").orderBy("rank").limit(clean))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    by_rank = Window.partitionBy("lang").orderBy("rank")
    spoken = docs.select("doc_id", lang.alias("lang"), rank().alias("rank")).filter(F.col("doc_id").isNotNull() & ~held_out(
        F.col("doc_id")) & (F.col("lang") != "")).withColumn("n", F.row_number().over(by_rank)).filter(F.col("n") <= LANGUAGE_TEXTS)
    some = some.unionAll(spoken.select("doc_id", F.lit(None).cast("int"), "rank").distinct())
    texts = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(some), "doc_id")  # clean + toxic rows at most
    cut = texts.select("rank", "lang", "toxic", "text").mapInArrow(
        _tokens, "rank long, lang string, toxic int, ids binary, words long")
    cut = written(cut.withColumns({"at": F.monotonically_increasing_id(), "order": F.xxhash64("ids", "lang")}), "training")
    chosen = []
    for kind, most in ((1, toxic), (0, clean)):
        # Numbers only, as many as the sample has rows; repeated rows of a document count once.
        rows = cut.filter(F.col("toxic") == kind).groupBy("rank", "order").agg(
            F.min("words").alias("words"), F.min("at").alias("at")).orderBy("rank", "order").limit(most)
        taken = within_budget(rows.collect(), most, words // 2)
        chosen += [(at,) for at in taken]
    picked = docs.sparkSession.createDataFrame(chosen, "at long")
    profiles = cut.filter("toxic IS NULL").withColumn("n", F.row_number().over(
        Window.partitionBy("lang").orderBy("rank", "order"))).filter(F.col("n") <= LANGUAGE_TEXTS)
    return cut.join(F.broadcast(picked), "at").unionByName(profiles.drop("n")).select("rank", "lang", "toxic", "ids")


def no_model(docs: DataFrame, labels: DataFrame) -> None:
    """Without a model all labelled documents must be of one kind; else nothing could be learnt from texts so long."""
    known = docs.select("doc_id").join(labelled(labels), "doc_id")
    if known.select("toxic").distinct().count() == 2:
        raise ValueError("labels of both kinds exist, but the training sample has only one: the texts of the other "
                         "have more words than its budget, or no sampled label has a document")


def fit(rows: list) -> tuple[Model, list[Model | None]] | None:
    """The model and, for each fold, one that has not seen the fold's rows."""
    if not {0, 1} <= {r["toxic"] for r in rows}:
        return None
    texts = [np.frombuffer(r["ids"], np.uint16).astype(np.int32).reshape(-1, HASHES) for r in rows]
    model = Model()
    learn_languages(model, texts, [r["lang"] for r in rows])
    learnt = [i for i, r in enumerate(rows) if r["toxic"] is not None]
    texts, toxic = [texts[i] for i in learnt], np.array([rows[i]["toxic"] for i in learnt])
    # What stands in a few texts only says nothing about others: such buckets stay at zero.
    seen_in = np.zeros(BUCKETS + 1, np.int64)
    for ids in texts:
        seen_in[np.unique(ids)] += 1
    rare = seen_in < LEAST_TEXTS
    texts = [np.where(rare[ids], BUCKETS, ids).astype(np.int32) for ids in texts]
    part, folds = np.array([rows[i]["rank"] % FOLDS for i in learnt]), []
    for k in range(FOLDS):
        other = np.flatnonzero(part != k)
        folds.append(None)
        if len(set(toxic[other].tolist())) == 2:
            folds[k] = Model(seed=50 + k)
            train(folds[k], [texts[i] for i in other], toxic[other])
            folds[k].embedding[rare] = 0
    train(model, texts, toxic)
    model.embedding[rare] = 0
    return model, folds


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task trains on the sample, whose size is bounded; the driver only sees the models."""
    rows = sorted((r for batch in batches for r in batch.to_pylist()),
                  key=lambda r: (r["rank"], r["ids"], -1 if r["toxic"] is None else r["toxic"], r["lang"] or ""))
    yield pa.record_batch([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])


def _unseen(shared):
    """Guessed language and cell of the logit of every row, by the model of its fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, folds = shared.value
        for batch in batches:
            part = batch.column("fold").to_numpy(zero_copy_only=False)
            for a, b, raw, offsets in slices(batch.column("text"), SLICE):
                ids, first = word_ids(raw, offsets)
                spoken = model.language(ids, first)
                for k, one in enumerate(folds):
                    mine = np.flatnonzero(part[a:b] == k)
                    if one is None or not len(mine):
                        continue
                    z = one.logits(*joined([ids[first[i]:first[i + 1]] for i in mine]))
                    cell = np.clip(np.floor(z * CELLS), -FARTHEST * CELLS, FARTHEST * CELLS - 1).astype(np.int32)
                    yield pa.record_batch([batch.column("doc_id").take(pa.array(a + mine)), pa.array(spoken[mine].astype(np.int32)),
                                           pa.array(cell)], ["doc_id", "language", "cell"])
    return run


def unseen_counts(docs: DataFrame, labels: DataFrame, models: tuple) -> DataFrame:
    """language, cell, toxic, n over all labelled documents that are not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.pmod(rank(), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    cells = rows.mapInArrow(_unseen(shared), f"doc_id {kind}, language int, cell int")
    return cells.join(labelled(labels), "doc_id").groupBy("language", "cell", "toxic").agg(F.count("*").alias("n"))


def trained(docs: DataFrame, labels: DataFrame, **sample: int) -> Model | None:
    found = training_rows(docs, labels, **sample).repartition(1).mapInArrow(_fit, "model binary").collect()
    models = pickle.loads(found[0]["model"]) if found else None
    if models is None:
        no_model(docs, labels)
        return None
    calibrate(models[0], unseen_counts(docs, labels, models).collect())
    return models[0]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [np.zeros(0)]
            for a, b, raw, offsets in slices(batch.column("_text"), SLICE):
                found.append(model.scores(*word_ids(raw, offsets)) if model else np.zeros(b - a))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(np.concatenate(found), pa.float64())],
                                  [*(batch.schema.names[i] for i in keep), "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, carry: list[str] = ("doc_id",), **sample: int) -> DataFrame:
    """The columns of `carry` and the score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **sample))
    rows = docs.select(*carry, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_score(shared), f"{kinds}, score double")
