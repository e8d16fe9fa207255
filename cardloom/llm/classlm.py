"""Class-based n-gram model: exchange clustering of words, class transitions and word emissions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.staging import drop_stage, staged
from cardloom.llm.words import utf8

#: Documents whose crc32 leaves this remainder are held out of training.
FOLDS, HELD_OUT = 7, 2


@dataclass(frozen=True)
class ClassModel:
    """Sizes of the model; none depends on the corpus.

    ``clustered`` of the most frequent words are dealt to ``classes`` by exchange; all others share ``endings`` classes by
    their last two bytes, and the end of a document has a class of its own. ``known`` of the most frequent words are sent
    to the tasks with their counts (some 100 bytes each); all others get their counts by a join.
    """

    classes: int = 64
    endings: int = 32
    clustered: int = 4096
    known: int = 65536
    rounds: int = 6
    shares: int = 4
    prior: float = 50.0

    @property
    def all_classes(self) -> int:
        return self.classes + self.endings + 1

    @property
    def end(self) -> int:
        return self.classes + self.endings

    def ending(self, word: bytes) -> int:
        return self.classes + zlib.crc32(word[-2:]) % self.endings


def words_of(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, split at ASCII white space only."""
    return data.lower().split()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for data in utf8(batch.column("text")):
            counts.update(words_of(data))
            if len(counts) > 1 << 18:
                yield _counted(counts)
                counts.clear()
    if counts:
        yield _counted(counts)


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    words = pa.array(list(counts), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _pair_counts(ranks: dict[bytes, int], model: ClassModel) -> Callable:
    """Counts of neighbouring tokens. A clustered word is its rank; any other is ``clustered`` plus its class."""
    shift = model.clustered
    width = shift + model.all_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        end = shift + model.end
        for batch in batches:
            for data in utf8(batch.column("text")):
                words = words_of(data)
                ids = [end, *(ranks[w] if w in ranks else shift + model.ending(w) for w in words), end]
                tokens = np.array(ids, dtype=np.int64)
                held.append(tokens[:-1] * width + tokens[1:])
                size += len(tokens)
                if size > 1 << 21:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        arrays = [pa.array(pairs // width), pa.array(pairs % width), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["left", "right", "n"])

    return run


def _pairs(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    if value.values is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    flat = value.values
    return flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(matrix: np.ndarray, now: int, left: np.ndarray, right: np.ndarray, own: float, classes: int) -> int:
    """The class of the first ``classes`` that raises the likelihood of all class pairs most if the word moves there."""
    rest = matrix.copy()
    rest[:, now] -= left
    rest[now, :] -= right
    rest[now, now] -= own
    into, out = rest[:, :classes], rest[:classes, :]
    gain = (_entropy(into + left[:, None]) - _entropy(into)).sum(axis=0)
    gain += (_entropy(out + right) - _entropy(out)).sum(axis=1)
    loops = rest.diagonal()[:classes]
    gain -= _entropy(loops + left[:classes]) + _entropy(loops + right[:classes]) - 2 * _entropy(loops)
    gain += _entropy(loops + left[:classes] + right[:classes] + own) - _entropy(loops)
    for axis, more in ((1, right.sum() + own), (0, left.sum() + own)):
        totals = matrix.sum(axis=axis)
        totals[now] -= more
        gain -= (_entropy(totals + more) - _entropy(totals))[:classes]
    best = int(np.argmax(gain))
    return best if gain[best] > gain[now] + 1e-9 else now


def _class_pairs(of: np.ndarray, model: ClassModel) -> Callable:
    """Counts of class pairs from the rows' right neighbours."""
    k = model.all_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((k, k))
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, n = _pairs(batch.column("after")[i])
                matrix[of[batch.column("token")[i].as_py()]] += np.bincount(of[tokens], n, minlength=k)
        a, b = np.nonzero(matrix)
        arrays = [pa.array(a), pa.array(b), pa.array(matrix[a, b].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n"])

    return run


def _moves(of: np.ndarray, matrix: np.ndarray, model: ClassModel) -> Callable:
    """New class of each word. Rows come by share and token; a share sees its own moves at once, those of others later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, mine, counts = None, of, matrix
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                if batch.column("share")[i].as_py() != share:
                    share, mine, counts = batch.column("share")[i].as_py(), of.copy(), matrix.copy()
                token = batch.column("token")[i].as_py()
                before, after = (_pairs(batch.column(name)[i]) for name in ("before", "after"))
                own = float(after[1][after[0] == token].sum())
                left, right = (
                    np.bincount(mine[t[t != token]], n[t != token], minlength=len(counts)) for t, n in (before, after)
                )
                to = best_class(counts, int(mine[token]), left, right, own, model.classes)
                for where, sign in ((mine[token], -1), (to, 1)):
                    counts[:, where] += sign * left
                    counts[where, :] += sign * right
                    counts[where, where] += sign * own
                mine[token] = to
                found.append((token, to))
            arrays = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "to"])

    return run


def _matrix(profiles: DataFrame, of: np.ndarray, model: ClassModel) -> np.ndarray:
    matrix = np.zeros((model.all_classes, model.all_classes))
    pairs = profiles.mapInArrow(_class_pairs(of, model), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for row in pairs.collect():  # at most all_classes squared
        matrix[row["a"], row["b"]] = row["n"]
    return matrix


def clustered(profiles: DataFrame, words: int, model: ClassModel) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token and the counts of class pairs, after ``rounds`` of exchange.

    In each round the words of each share, by rank, move one after another to the class that is best for the likelihood;
    shares work side by side from the counts at the start of the round, which are taken anew after it. So the outcome
    does not depend on how rows are dealt to tasks.
    """
    of = np.concatenate((np.arange(model.clustered) % model.classes, np.arange(model.all_classes)))
    matrix = _matrix(profiles, of, model)
    movers = profiles.where(F.col("token") < words).withColumn("share", F.col("token") % model.shares)
    movers = movers.repartition("share").sortWithinPartitions("share", "token")
    for _ in range(model.rounds):
        moved = movers.mapInArrow(_moves(of, matrix, model), "token long, to long").collect()  # at most ``clustered`` rows
        for row in moved:
            of[row["token"]] = row["to"]
        matrix = _matrix(profiles, of, model)
    return of, matrix


def _scored(sent, model: ClassModel) -> Callable:
    """Rows with what known words and transitions add, and the other words with their counts in the row.

    ``sent`` has class, log emission and log count of the known words, log transitions, the same of the end with whether
    it is known, and the log of the base's denominator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, transitions, (end_emission, end_base, end_known), norm = sent.value
        for batch in batches:
            rows = []
            for data in utf8(batch.column("text")):
                words = words_of(data)
                classes, others = [model.end], []
                score, base, n_known = end_emission, end_base, int(end_known)
                for word in words:
                    one = known.get(word)
                    if one is None:
                        classes.append(model.ending(word))
                        others.append(word)
                    else:
                        classes.append(one[0])
                        score += one[1]
                        base += one[2]
                        n_known += 1
                classes.append(model.end)
                path = np.array(classes)
                score += float(transitions[path[:-1], path[1:]].sum())
                n = len(words) + 1
                rest = [{"word": w, "class": model.ending(w), "n": c} for w, c in Counter(others).items()]
                rows.append((n, n_known, base - n * norm, score, rest))
            n_tokens, n_known, base, score, rest = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "n_known": pa.array(n_known, pa.int64()),
                    "base": pa.array(base, pa.float64()),
                    "score": pa.array(score, pa.float64()),
                    "rest": pa.array(rest, _REST),
                }
            )

    return run


_REST = pa.list_(pa.struct([("word", pa.string()), ("class", pa.int32()), ("n", pa.int32())]))


def _with_class(model: ClassModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [model.ending(word) for word in utf8(batch.column("word"))]
            arrays = [pa.array(classes, pa.int32()), batch.column("n")]
            yield pa.RecordBatch.from_arrays(arrays, names=["class", "n"])

    return run


def _most_frequent(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """At most ``limit`` words with their counts, the most frequent first; all words of one count or none of them.

    How many words have each count tells from which count on they are few enough, so no task sends more than those.
    """
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(limit)
    least, words = None, 0
    for row in sizes.collect():
        words += row["words"]
        if words > limit:
            break
        least = row["n"]
    if least is None:
        return []
    found = [(row["word"].encode(), row["n"]) for row in counts.where(F.col("n") >= least).collect()]
    return sorted(found, key=lambda pair: (-pair[1], pair[0]))


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def class_scores(docs: DataFrame, model: ClassModel | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): counts, the unigram base score and the class model's score.

    The model learns from all rows that are not held out: p(word | previous word) is the share of the word's class after
    the previous word's class, smoothed by ``prior`` times the class's own share, times the word's share in its class,
    where one more word stands for all unknown ones. ``score`` is its log10, ``perplexity`` that per token.

    Null and empty texts are just an end. A null ``doc_id`` is not held out. Repeated rows count each for themselves.
    Other columns are not read. With no row to learn from all counts are 0; an empty table gives none.
    """
    model = model or ClassModel()
    spark = docs.sparkSession
    training = docs.where(~held_out(docs)).select("text")
    counts = training.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = staged(counts, "word-counts")
    ends = training.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    top = _most_frequent(counts, model.known)

    ranks = {word: i for i, (word, _) in enumerate(top[: model.clustered])}
    pairs = training.mapInArrow(_pair_counts(ranks, model), "left long, right long, n long")
    pairs = staged(pairs.groupBy("left", "right").agg(F.sum("n").alias("n")), "word-pairs")
    after = pairs.groupBy(F.col("left").alias("token")).agg(F.collect_list(F.struct("right", "n")).alias("after"))
    before = pairs.groupBy(F.col("right").alias("token")).agg(F.collect_list(F.struct("left", "n")).alias("before"))
    profiles = staged(after.join(before, "token", "full").repartition("token"), "word-profiles")
    drop_stage(pairs)
    of, matrix = clustered(profiles, len(ranks), model)
    drop_stage(profiles)

    # Tokens and distinct words of each class: of the endings' classes all words but the clustered ones.
    sizes, kinds = np.zeros(model.all_classes), np.zeros(model.all_classes)
    rows = counts.mapInArrow(_with_class(model), "class int, n long").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    for row in rows.collect():  # one per class of endings
        sizes[row["class"]], kinds[row["class"]] = row["n"], row["v"]
    for word, count in top[: model.clustered]:
        for where, sign in ((model.ending(word), -1), (of[ranks[word]], 1)):
            sizes[where] += sign * count
            kinds[where] += sign
    sizes[model.end], kinds[model.end] = ends, ends > 0
    room = np.log10(sizes + kinds + 1)
    shares = (sizes + 1) / (sizes.sum() + model.all_classes)
    transitions = np.log10((matrix + model.prior * shares) / (matrix.sum(axis=1, keepdims=True) + model.prior))
    known = {}
    for i, (word, count) in enumerate(top):
        where = int(of[i]) if i < model.clustered else model.ending(word)
        known[word] = (where, float(np.log10(count + 1) - room[where]), float(np.log10(count + 1)))
    end = (float(np.log10(ends + 1) - room[model.end]), float(np.log10(ends + 1)), ends > 0)
    norm = float(np.log10(n + v + 1))
    sent = spark.sparkContext.broadcast((known, transitions, end, norm))

    local = docs.select("doc_id", "text").mapInArrow(
        _scored(sent, model),
        "doc_id long, n_tokens long, n_known long, base double, score double, rest array<struct<word:string,class:int,n:int>>",
    )
    local = staged(local.withColumn("row", F.monotonically_increasing_id()), "scored")
    others = local.select("row", F.inline("rest")).join(counts.withColumnRenamed("n", "count"), "word", "left")
    log_count = F.log10(F.coalesce("count", F.lit(0)) + 1)
    log_room = F.element_at(F.array(*[F.lit(float(x)) for x in room]), F.col("class") + 1)
    added = others.groupBy("row").agg(
        F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * log_count).alias("more_base"),
        F.sum(F.col("n") * (log_count - log_room)).alias("more_score"),
    )
    found = local.drop("rest").join(added, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    score = plus("score", "more_score")
    return found.select(
        "doc_id",
        held_out(found).alias("held_out"),
        "n_tokens",
        plus("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
