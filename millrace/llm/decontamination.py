"""Benchmark decontamination by a distributed positional inverted index. Native DataFrame code only.

A first pass counts the documents' terms, with map-side combine. Each window of an item is then looked up by its RAREST terms
that are least frequent there, of those that some document has. A second pass stores the postings (document, term, position) of
these terms alone, and the length of each document. Postings, less the term's offset in the window, are intersected by
(document, window, start).

- Phrases: what is left of windows all of whose terms some document has is compared word by word with the document's text, of
  which only documents with candidates are read again.
- Proximity: places where a window's rarest terms stand up to `slack` words out of place, whatever stands between; so edited
  passages are found, with windows that have words of no document. Windows with one known term are left to phrases.

Windows have WINDOW consecutive words of an item; an item with fewer words, but some, is one window. Null texts have no words;
items without words have no windows. Null ids are ids of their own. Repeated documents get equal rows, repeated items count
once by id. Empty tables give no hits or no rows. Frequent terms, windows and passages stay spread: joins by term or window
broadcast hot keys alone, and what is broadcast besides is under BROADCAST_ROWS rows of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits, spread_join, staged, text_of

WINDOW, RAREST, SLACK = 13, 2, 3
#: Rows of terms, windows or document keys that may be broadcast (each well under 1 kB).
BROADCAST_ROWS = 100_000
#: Postings of a term, or windows' terms, that meet in one task; more are dealt over several.
ROWS_A_TASK = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a document's end in the index; no word holds it.
END = "\x01"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z as a-z, cut at ASCII characters other than letters and digits."""
    plain = F.octet_length(text) == F.length(text)  # lower() is right, and quicker, for ASCII
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words of each window of each item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(text_of(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - WINDOW + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, WINDOW))).alias("words"))


def _bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small; else it is shuffled."""
    return F.broadcast(df) if fits(df, BROADCAST_ROWS) else df


def rarest_terms(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """window, size, whole (whether documents have all its terms), terms (of those), rank, term, offset, count (in the
    documents): the terms by which each window is looked up."""
    terms = windows.select("window", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    vocabulary = terms.select("term").distinct()
    counted = documents.select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").count()
    counted = staged(counted.join(vocabulary, "term", "left_semi"), "index-frequencies")
    known = terms.join(counted, "term", "left")
    every = Window.partitionBy("window")
    known = known.withColumn("whole", F.count("count").over(every) == F.col("size")).where("count IS NOT NULL")
    ranked = known.withColumn("rank", F.row_number().over(every.orderBy("count", "term", "offset"))).withColumn("terms", F.count(F.lit(1)).over(every))
    return ranked.where(F.col("rank") <= RAREST).select("window", "size", "whole", F.least("terms", F.lit(RAREST)).alias("terms"), "rank", "term", "offset", "count")


def postings(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """d_id, d_hash, term, at, fan: the index. The position of END is the document's number of words. fan: over how many tasks a
    term's postings are dealt."""
    known = chosen.groupBy("term").agg(F.max("count").alias("count"))
    known = known.unionByName(documents.groupBy().agg(F.lit(END).alias("term"), F.count(F.lit(1)).alias("count")))
    known = staged(known.withColumn("fan", F.ceil(F.greatest("count", F.lit(1)) / ROWS_A_TASK)), "index-terms")
    listed = documents.select("d_id", "d_hash", F.posexplode(F.concat(words_of(F.col("text")), F.array(F.lit(END)))).alias("at", "term"))
    met = listed.join(F.broadcast(known.drop("count")), "term") if fits(known, BROADCAST_ROWS) else spread_join(listed, known, ["term"], "count")
    return met.select("d_id", "d_hash", "term", "at", "fan")


class Index:
    """The index of documents for the windows of a benchmark."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.documents = docs.select(F.col(id_col).alias("d_id"), text_of(text_col).alias("text")).withColumn("d_hash", F.xxhash64("text"))
        listed = item_windows(benchmark).distinct()
        self.windows = staged(listed.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "index-windows")
        self.items = staged(listed.join(self.windows, "words").select("window", "item_id"), "index-items")
        self.chosen = staged(rarest_terms(self.documents, self.windows), "index-chosen")
        self.postings = staged(postings(self.documents, self.chosen), "index-postings")

    def lengths(self) -> DataFrame:
        """d_id, d_hash, n_words of each document, repeated ones included."""
        return self.postings.where(F.col("term") == END).select("d_id", "d_hash", F.col("at").cast("long").alias("n_words"))

    def starts(self) -> DataFrame:
        """d_id, d_hash, window, size, whole, terms, rank, start: where a window would begin for each posting of its terms.

        Both sides are dealt by the term and, for frequent ones, a number that spreads its postings.
        """
        chosen = self.chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.greatest("count", F.lit(1)) / ROWS_A_TASK) - 1))).drop("count")
        met = self.postings.withColumn("salt", F.pmod(F.xxhash64("d_hash", "at"), "fan")).join(_bounded(chosen), ["term", "salt"])
        return met.select("d_id", "d_hash", "window", "size", "whole", "terms", "rank", (F.col("at") - F.col("offset")).alias("start"))

    def phrases(self) -> DataFrame:
        """d_id, d_hash, window, size, start of each occurrence of a window."""
        found = self.starts().where("whole AND start >= 0").groupBy("d_id", "d_hash", "window", "size", "terms", "start").agg(F.count_distinct("rank").alias("n"))
        found = staged(found.where("n = terms").select("d_id", "d_hash", "window", "size", "start"), "index-found")
        by_document = found.groupBy("d_id", "d_hash").agg(F.collect_list(F.struct("window", "size", "start")).alias("places"))
        wanted = staged(found.select("d_id", "d_hash").distinct(), "index-candidates")
        texts = _where(self.documents, _bounded(wanted), "left_semi").dropDuplicates(["d_id", "d_hash"])  # so that only their texts move, copies once
        texts = _where(texts, by_document.hint("merge"), "inner").select("d_id", "d_hash", "places", words_of(F.col("text")).alias("all"))
        cut = F.transform("places", lambda p: F.struct(p["window"].alias("window"), p["size"].alias("size"), p["start"].alias("start"), F.xxhash64(F.slice("all", p["start"] + 1, p["size"])).alias("h"), F.slice("all", p["start"] + 1, p["size"]).alias("read")))
        read = texts.select("d_id", "d_hash", F.explode(cut).alias("p")).select("d_id", "d_hash", "p.*")
        read = read.join(_bounded(staged(self.windows.select(F.col("window").alias("w"), "words", F.xxhash64("words").alias("w_hash")), "index-window-hashes")), (F.col("window") == F.col("w")) & (F.col("h") == F.col("w_hash")))
        return read.where(F.col("read") == F.col("words")).select("d_id", "d_hash", "window", "size", "start").distinct()

    def proximity(self, slack: int = SLACK) -> DataFrame:
        """d_id, d_hash, item_id, at: items whose windows' rarest terms stand together, in any order, up to slack words out of
        place, whether or not the rest is the same.

        Starts meet by pieces of slack + 1 words, not all of a document's with each other.
        """
        width = slack + 1
        near = self.starts().where("terms > 1").select("d_id", "d_hash", "window", "rank", "start").distinct()  # copies once
        near = near.withColumn("bin", F.floor(F.col("start") / width))
        one = near.where("rank = 1").withColumn("bin", F.explode(F.array(*[F.col("bin") + k for k in (-1, 0, 1)])))
        one = one.select(*[F.col(c).alias(f"x_{c}") for c in ("d_id", "d_hash", "window", "bin", "start")])
        on = F.col("d_id").eqNullSafe(F.col("x_d_id")) & (F.col("d_hash") == F.col("x_d_hash")) & (F.col("window") == F.col("x_window")) & (F.col("bin") == F.col("x_bin"))
        met = near.where("rank = 2").join(one, on & (F.abs(F.col("start") - F.col("x_start")) <= slack))
        met = met.groupBy("d_id", "d_hash", "window").agg(F.min(F.greatest(F.least("start", "x_start"), F.lit(0))).alias("at"))
        return met.join(_bounded(self.items), "window").groupBy("d_id", "d_hash", "item_id").agg(F.min("at").alias("at"))


def _where(documents: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """documents with what is known of them, by id and hash."""
    other = known.withColumnsRenamed({"d_id": "g_id", "d_hash": "g_hash"})
    joined = documents.join(other, F.col("d_id").eqNullSafe(F.col("g_id")) & (F.col("d_hash") == F.col("g_hash")), how)
    return joined if how == "left_semi" else joined.drop("g_id", "g_hash")


def _item(column: str = "item_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, slack: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, d_hash, n_words, n_hit, items (sorted ids, as strings) and contaminated; with a slack, near
    too: the sorted ids of the items that proximity finds.

    A document is contaminated if at least one in `share` of its words is within an occurrence of a window.
    """
    index = Index(docs, benchmark)
    phrases = staged(index.phrases(), "index-phrases")
    inside = phrases.select("d_id", "d_hash", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))
    hit = inside.distinct().groupBy("d_id", "d_hash").agg(F.count(F.lit(1)).alias("n_hit"))
    named = phrases.select("d_id", "d_hash", "window").distinct().join(_bounded(index.items), "window").select("d_id", "d_hash", _item().alias("item"))
    items = named.distinct().groupBy("d_id", "d_hash").agg(F.array_sort(F.collect_list("item")).alias("items"))
    known = _where(index.lengths(), _where(hit, items, "inner"), "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)), F.array().cast("array<string>")
    out = [F.col("d_id").alias("doc_id"), "d_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated")]
    if slack is not None:
        near = index.proximity(slack).groupBy("d_id", "d_hash").agg(F.array_sort(F.collect_set(_item())).alias("near"))
        known = _where(known, near, "left")
        out.append(F.coalesce("near", none).alias("near"))
    return known.select(*out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The rows of docs that are not contaminated."""
    bad = contamination(docs, benchmark, share).where("contaminated").select(F.col("doc_id").alias("b_id"), F.col("d_hash").alias("b_hash")).distinct()
    bad = staged(bad, "index-contaminated")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64(text_of("text")).alias("hash"))
    return keyed.join(_bounded(bad), F.col("id").eqNullSafe(F.col("b_id")) & (F.col("hash") == F.col("b_hash")), "left_anti").select("doc.*")
