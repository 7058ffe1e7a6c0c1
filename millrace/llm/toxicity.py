"""Toxicity by class-conditional Kneser-Ney models of characters in words.

Two models, of toxic and of ordinary documents, give the chance of each character of a word after the ORDER - 1 before it. The
highest order has counts of its class alone; both back off to the same lower orders, one character less each time down to single
characters and at last UNIFORM. Their counts come from all documents, labelled or not: how many different characters stand
before a string, or how often it begins a word. So a rare word, which the classes have hardly seen, gets nearly the same chance
from both, and only what one class repeats tells them apart.

A document's score comes from its words' log-likelihood ratios through a logistic curve, which is fitted to training rows that
took no part in the class counts. The mean ratio, normalised by length, is one term; as one insult in a long document hardly
moves it, the length-normalised sum of what is above 2, the highest ratio, the share above 4 and the length stand beside it.

Class counts come from a hash sample of at most about MAX_LABELS labelled rows outside the held-out fold, the shared counts
from every word of every document. Words are runs of letters; Spark makes them, for counting and for scoring. Null texts count
as empty; texts without letters get the score of a document whose words say nothing. Documents with a null id are never held
out; of repeated ids the row with the least features calibrates. Repeated rows get equal scores. Without labels of both kinds
every score is the share of label 1, or 0 without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, kept, map_arrow, spread_join, staged, text_of
from .learning import held_out, logistic, training_labels

#: Labelled rows used, at most (about): they are broadcast, at 24 bytes each.
MAX_LABELS = 300_000
#: Ratios of at most so many n-grams are sent to the workers (12 bytes each); with more, words meet their ratios by a join.
MODEL_ROWS = 6_000_000
#: Characters of an n-gram; the discount; the chance of a character about which nothing is known.
ORDER, DISCOUNT, UNIFORM = 6, 0.75, 1 / 256
#: Words remembered by a worker; at this number the memory is emptied.
MEMO = 600_000
#: Words that are looked up at once: their n-grams are lists of strings, some twenty times as large as the words.
TOGETHER = 4_000
#: Share of the training rows, in hundredths, that makes the counts; the rest calibrates.
COUNTED = 70


def words_of(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


FEATURES = ("mean", "excess", "most", "marked", "length")


def word_counts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """word, n_tox, n_ord, n_all over all documents; the classes count the chosen labels alone."""
    base = docs.join(F.broadcast(chosen.where(F.col("part") < COUNTED).select("doc_id", "label")), "doc_id", "left")
    words = base.select("label", F.explode(words_of(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("n_tox"), F.count_if(F.col("label") == 0).alias("n_ord"), F.count(F.lit(1)).alias("n_all"))


def grams_of(word: Column) -> Column:
    """The n-grams that end at each character of the word and at its end; '_' stands for the word's ends.

    The word is cut into characters once, in a list that a lambda holds, so the work is linear in its length.
    """
    ends = F.array(F.lit("_"))

    def of(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat_ws("", *[F.get(chars, i - k) for k in range(ORDER - 1, -1, -1)]))

    return F.element_at(F.transform(F.array(F.concat(ends, F.split(word, ""), ends)), of), 1)


def _before(gram: str) -> Column:
    return F.expr(f"left({gram}, length({gram}) - 1)")


def shared(grams: DataFrame) -> DataFrame:
    """tail, p: Kneser-Ney chances of the last character of strings of 1 to ORDER - 1 characters after the others.

    grams: gram, n_all. A string at a word's beginning counts as often as it stands there, another one with its different
    characters before; each order follows from the one above.
    """
    levels, above = {}, grams.where(F.length("gram") == ORDER).select(F.col("gram").alias("tail"))
    for order in range(ORDER - 1, 0, -1):
        inner = above.groupBy(F.expr(f"right(tail, {order})").alias("tail")).agg(F.count(F.lit(1)).alias("n"))
        first = grams.where((F.length("gram") == order) & F.col("gram").startswith("_")).select(F.col("gram").alias("tail"), F.col("n_all").alias("n"))
        levels[order] = staged(inner.unionByName(first), f"toxicity-order-{order}")
        above = levels[order].select("tail")
    out = lower = None
    for order in range(1, ORDER):
        level = levels[order].withColumn("head", _before("tail"))
        heads = level.groupBy(F.col("head").alias("h_head")).agg(F.sum("n").alias("h_n"), F.count(F.lit(1)).alias("h_tails"))
        joined = level.join(heads, F.col("head") == F.col("h_head"))
        back = F.lit(UNIFORM)
        if lower is not None:
            joined = joined.join(lower.select(F.col("tail").alias("l_tail"), F.col("p").alias("l_p")), F.expr(f"right(tail, {order - 1})") == F.col("l_tail"), "left")
            back = F.coalesce("l_p", F.lit(UNIFORM))
        lower = staged(joined.select("tail", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("h_tails") * back) / F.col("h_n")).alias("p")), f"toxicity-shared-{order}")
        out = lower if out is None else out.unionByName(lower)
    return out


def ratios(counts: DataFrame) -> DataFrame:
    """text, llr: the log-likelihood ratio of each n-gram that a class has seen, and, under '<' and a context, of any other
    character after that context."""
    each = counts.select(F.explode(grams_of(F.col("word"))).alias("gram"), "n_tox", "n_ord", "n_all")
    grams = staged(each.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n_tox", "n_ord", "n_all")]), "toxicity-grams")
    seen = grams.where("n_tox + n_ord > 0").withColumn("head", _before("gram")).withColumn("tail", F.expr("right(gram, length(gram) - 1)"))
    heads = seen.groupBy("head").agg(F.sum("n_tox").alias("c_tox"), F.sum("n_ord").alias("c_ord"), F.count_if(F.col("n_tox") > 0).alias("t_tox"), F.count_if(F.col("n_ord") > 0).alias("t_ord"))
    heads = staged(heads, "toxicity-contexts")
    met = seen.join(heads, "head").join(shared(grams), "tail", "left").withColumn("p", F.coalesce("p", F.lit(UNIFORM)))

    def chance(c: str) -> Column:
        own = (F.greatest(F.col(f"n_{c}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"t_{c}") * F.col("p")) / F.col(f"c_{c}")
        return F.when(F.col(f"c_{c}") > 0, own).otherwise(F.col("p"))

    def left_over(c: str) -> Column:
        return F.when(F.col(f"c_{c}") > 0, DISCOUNT * F.col(f"t_{c}") / F.col(f"c_{c}")).otherwise(1.0)

    known = met.select(F.col("gram").alias("text"), F.log(chance("tox") / chance("ord")).cast("float").alias("llr"))
    other = heads.select(F.concat(F.lit("<"), "head").alias("text"), F.log(left_over("tox") / left_over("ord")).cast("float").alias("llr"))
    return known.unionByName(other)


def _aggregates(n: Column, total: Column, excess: Column, most: Column, marked: Column) -> list[Column]:
    some = F.greatest(n, F.lit(1))
    return [(total / some).alias("mean"), (excess / some).alias("excess"), F.coalesce(most, F.lit(0.0)).alias("most"), (marked / some).alias("marked"), F.log1p(n.cast("double")).alias("length")]


def measured(docs: DataFrame, counts: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id and the FEATURES of each row: mean ratio of its words, mean of what is over 2, the highest, share over 4, and
    the logarithm of the number of words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    if not fits(model, MODEL_ROWS):
        pairs = counts.select("word", "n_all", F.explode(grams_of(F.col("word"))).alias("text"))
        known = pairs.join(model, "text", "left").withColumn("head", F.concat(F.lit("<"), _before("text")))
        known = known.join(model.select(F.col("text").alias("head"), F.col("llr").alias("miss")), "head", "left")
        by_word = staged(known.groupBy("word", "n_all").agg(F.sum(F.coalesce("llr", "miss", F.lit(0.0))).alias("x")), "toxicity-ratios")
        numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "words")
        each = numbered.select("row", "doc_id", F.explode_outer("words").alias("word")).groupBy("row", "doc_id", "word").agg(F.count("word").alias("times"))
        each = staged(each, "toxicity-document-words")
        met = spread_join(each.where("word IS NOT NULL"), by_word, ["word"], "n_all").select("row", "doc_id", "x", "times")
        met = met.unionByName(each.where("word IS NULL").select("row", "doc_id", F.lit(None).cast("double").alias("x"), "times"))
        x, n = F.col("x"), F.col("times")
        sums = [F.sum(n).alias("n"), *[F.coalesce(F.sum(v * n), F.lit(0.0)).alias(c) for c, v in (("s", x), ("e", F.greatest(x - 2, F.lit(0.0))))], F.max(x).alias("m"), F.sum(F.when(x > 4, n).otherwise(0)).alias("k")]
        summed = met.groupBy("row", "doc_id").agg(*sums)
        return summed.select("doc_id", *_aggregates(F.col("n"), F.col("s"), F.col("e"), F.col("m"), F.col("k")))

    table = model.select(F.xxhash64("text").alias("key"), "llr").toArrow()  # at most MODEL_ROWS
    keys, values = table.column("key").to_numpy(), table.column("llr").to_numpy().astype(np.float32)
    order = np.argsort(keys)
    shared_ratios = docs.sparkSession.sparkContext.broadcast((keys[order], values[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept.get("toxicity")
        if scorer is None or scorer.shared is not shared_ratios.value:
            scorer = kept["toxicity"] = WordRatios(shared_ratios.value)
        for batch in batches:
            if batch.num_rows:
                found = scorer.features(batch.column("words"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[:, i]) for i in range(len(FEATURES))]], ["doc_id", *FEATURES])

    return map_arrow(rows, run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in FEATURES), "toxicity")


class WordRatios:
    """Log-likelihood ratios of words, remembered."""

    def __init__(self, shared: tuple[np.ndarray, np.ndarray]) -> None:
        self.shared, self.memo = shared, {}

    def _find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ratios, and which of them are known."""
        from xxhash import xxh64_intdigest

        keys, values = self.shared
        wanted = np.array([xxh64_intdigest(t, 42) for t in texts], dtype=np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        return np.where(known, values[at] if len(keys) else 0, 0).astype(np.float64), known

    def _learn(self, words: list[str]) -> None:
        grams: list[str] = []
        ends: list[int] = []
        for w in words:
            padded = f"_{w}_"
            grams += [padded[max(0, i - ORDER) : i] for i in range(2, len(padded) + 1)]
            ends.append(len(grams))
        x, known = self._find(grams)
        missing = np.flatnonzero(~known)
        if len(missing):
            x[missing] = self._find([f"<{grams[i][:-1]}" for i in missing.tolist()])[0]
        self.memo.update(zip(words, np.add.reduceat(x, [0, *ends[:-1]]).tolist()))

    def of(self, words: list[str]) -> np.ndarray:
        """The ratios of different words."""
        unknown = [w for w in words if w not in self.memo]
        if unknown:
            if len(self.memo) + len(unknown) > MEMO:
                self.memo.clear()
                unknown = words
            for at in range(0, len(unknown), TOGETHER):
                self._learn(unknown[at : at + TOGETHER])
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.float64, count=len(words))

    def features(self, words: pa.ListArray) -> np.ndarray:
        """A row of FEATURES for each list of words."""
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(n), len(FEATURES)))
        some = np.flatnonzero(n)
        if len(some):
            coded = words.flatten().dictionary_encode()
            x = self.of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            starts = (np.cumsum(n) - n)[some]
            sums = [np.add.reduceat(v, starts) / n[some] for v in (x, np.maximum(x - 2, 0), x > 4)]
            out[some] = np.column_stack([sums[0], sums[1], np.maximum.reduceat(x, starts), sums[2], np.log1p(n[some])])
        return out


def _design(f: np.ndarray) -> np.ndarray:
    mean, excess, most, marked, length = f.T
    return np.column_stack([mean, np.log1p(20 * excess), np.sqrt(excess), most, np.log1p(50 * marked), length, np.log1p(20 * excess) * length])


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, fold: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    chosen = staged(training_labels(labels, label_col, folds, fold, MAX_LABELS), "toxicity-labels")
    ones = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = ["doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out")]
    prior = ones.get(1, 0) / sum(ones.values()) if ones else 0.0
    if len(ones) < 2:
        return base.select(*out, F.lit(prior).alias("score"), F.lit(int(prior >= threshold)).alias("predicted"))
    counts = staged(word_counts(base, chosen), "toxicity-words")
    found = staged(measured(base, counts, staged(ratios(counts), "toxicity-model")), "toxicity-features")
    fitting = found.join(F.broadcast(chosen.where(F.col("part") >= COUNTED)), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "label")).alias("x"))
    fitting = fitting.orderBy("doc_id").select("x.*").toArrow()  # at most MAX_LABELS
    y = np.array(fitting.column("label").to_pylist(), dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return found.select(*out, F.lit(prior).alias("score"), F.lit(int(prior >= threshold)).alias("predicted"))
    x = _design(np.column_stack([fitting.column(c).to_numpy() for c in FEATURES]))
    mean, deviation = x.mean(0), np.maximum(x.std(0), 1e-9)
    weights = logistic((x - mean) / deviation, y)
    slopes = weights[:-1] / deviation
    constant = float(weights[-1] - (slopes * mean).sum())
    strong = F.log1p(20 * F.col("excess"))
    terms = [F.col("mean"), strong, F.sqrt("excess"), F.col("most"), F.log1p(50 * F.col("marked")), F.col("length"), strong * F.col("length")]
    margin = sum((float(w) * t for w, t in zip(slopes, terms)), F.lit(constant))
    score = 1 / (1 + F.exp(-margin))
    return found.select(*out, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
