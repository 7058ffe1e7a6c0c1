"""Line dedup by a log-template tree of fixed depth. Native DataFrame code only.

A line's tokens are its pieces between white space; a token with a digit is a variable field from the start, FIELD. Lines with
fewer other tokens than FIXED, as rows of numbers, are compared as they stand and enter no tree. The others are compared by
their tokens, and go down the tree by their number of tokens, then by their first LEAD tokens, to a leaf.

A leaf holds several templates. Its different lines count as often as there are documents with them. A token is constant for
its leaf and place if more than half of what follows the token before it is this token, and if it stands there in at least
TEMPLATE_DOCS (document, line) pairs; FIELD is never constant. Places without a constant are variable fields. A line's
template is its number of tokens, its first LEAD tokens and its constants; so lines that go other ways after a shared
beginning make templates of their own, each counted on its own lines alone.

Dropped, but for the first document that has it (by id, then text hash; all its lines stay):
- an equal line that stands in two documents or more;
- a template that stands in at least TEMPLATE_DOCS documents and whose constants, leading tokens included, are FIXED of its
  places or more.
Lines of fewer than MIN_TOKENS tokens and fewer than MIN_CHARS characters besides white space are never dropped.

Null texts count as empty and have one empty line. Null ids come last; rows equal in id and text are one document, which counts
once, and get equal rows. Empty tables give no rows. Lines and templates are counted by hash with map-side combine, and frequent
ones are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, spread_join, staged, text_of

LEAD, MIN_TOKENS, MIN_CHARS, TEMPLATE_DOCS = 3, 3, 10, 3
#: At least FIXED[0] of FIXED[1] of a template's places are constant.
FIXED = (3, 5)
FIELD = "<*>"
_DOCUMENT = ("d_id", "d_hash")


def tokens_of(line: Column) -> Column:
    """The line's tokens; those with a digit become FIELD."""
    field = rf"(?<![^{WS}])[^{WS}0-9]*+[0-9][^{WS}]*"  # from a token's start, and never back over what was read
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, field, FIELD)).otherwise(line)
    return _words(masked)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, f"[{WS}]+"), "")


def text_hash(text: Column) -> Column:
    """60 bits that stand for a text and order documents of one id."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _here() -> Column:
    return F.struct(F.col("d_id").isNull(), *_DOCUMENT)


def _lines(documents: DataFrame) -> DataFrame:
    """d_id, d_hash, no, judged, line (hash of what is compared), leaf (hash; null outside the tree) of every line.

    Short lines are left in: with a filter or a condition here, Spark would make a line's tokens once for each use.
    """
    each = documents.select(*_DOCUMENT, F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    tokens = tokens_of(F.col("raw"))
    enough = FIXED[1] * F.size(F.array_remove(tokens, FIELD)) >= FIXED[0] * F.size(tokens)
    line = F.when(enough, F.xxhash64(tokens)).otherwise(F.xxhash64(_words(F.col("raw"))))
    leaf = F.when(enough, F.xxhash64(F.size(tokens), F.slice(tokens, 1, LEAD)))
    judged = F.when(F.size(tokens) >= MIN_TOKENS, True).otherwise(F.length(F.translate("raw", " \t\n\x0b\x0c\r", "")) >= MIN_CHARS)
    return each.select(*_DOCUMENT, "no", judged.alias("judged"), line.alias("line"), leaf.alias("leaf"))


def _with(documents: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """documents with what is known of them; always by a shuffle, which costs the same share of the input at each size."""
    other = known.withColumnsRenamed({"d_id": "g_id", "d_hash": "g_hash"}).hint("merge")
    return documents.join(other, F.col("d_id").eqNullSafe(F.col("g_id")) & (F.col("d_hash") == F.col("g_hash")), how).drop("g_id", "g_hash")


def _different(documents: DataFrame, inside: DataFrame) -> DataFrame:
    """line, leaf, n_docs and tokens of the different lines of inside (d_id, d_hash, no, line, leaf); one of each is read
    again."""
    once = inside.groupBy("leaf", "line", *_DOCUMENT).agg(F.min("no").alias("no"))
    shown = once.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(F.col("d_id").isNull(), *_DOCUMENT, "no")).alias("at"))
    wanted = shown.groupBy(F.col("at.d_id").alias("d_id"), F.col("at.d_hash").alias("d_hash")).agg(F.collect_list(F.struct("line", "leaf", "n_docs", "at.no")).alias("wanted"))
    texts = _with(documents, wanted, "inner").withColumn("lines", F.split("text", "\n"))
    raw = F.transform("wanted", lambda w: F.struct(w["line"].alias("line"), w["leaf"].alias("leaf"), w["n_docs"].alias("n_docs"), F.get("lines", w["no"]).alias("raw")))
    each = texts.select(F.explode(raw).alias("l")).select("l.*").dropDuplicates(["line"])  # repeated rows show a line several times
    return each.select("line", "leaf", "n_docs", tokens_of(F.col("raw")).alias("tokens"))


def templates(different: DataFrame) -> DataFrame:
    """line, template (a hash) of the different lines (line, leaf, n_docs, tokens) whose templates have enough constants."""
    places = F.transform(F.slice("tokens", LEAD + 1, F.greatest(F.size("tokens") - LEAD, F.lit(0))), lambda t, i: F.struct((i + LEAD).alias("place"), F.get("tokens", i + LEAD - 1).alias("last"), t.alias("token")))
    each = different.select("line", "leaf", "n_docs", F.explode(places).alias("p")).select("line", "n_docs", F.xxhash64("leaf", "p.place").alias("spot"), "p.*")
    each = each.select("line", "n_docs", "place", "token", F.xxhash64("spot", "last").alias("after"), F.xxhash64("spot", "token").alias("here"))
    counted = staged(each.groupBy("after", "here", "token").agg(F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("rows")), "line-tokens")
    often = counted.groupBy("here").agg(F.sum("n").alias("all")).where(F.col("all") >= TEMPLATE_DOCS).select("here")
    most = counted.groupBy("after").agg(F.max_by("here", "n").alias("here"), F.max("n").alias("n"), F.sum("n").alias("all"), F.sum("rows").alias("rows"), F.max_by("token", "n").alias("token"))
    constant = most.where((2 * F.col("n") > F.col("all")) & (F.col("token") != FIELD)).join(often, "here", "left_semi")
    constant = staged(constant.select("after", F.col("here").alias("fixed"), "rows"), "line-constants")
    met = spread_join(each, constant, ["after"], "rows").where("here = fixed")
    fixed = met.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("fixed"))
    joined = different.join(fixed, "line", "left")
    known = F.size(F.array_remove(F.slice("tokens", 1, LEAD), FIELD)) + F.coalesce(F.size("fixed"), F.lit(0))
    return joined.where(FIXED[1] * known >= FIXED[0] * F.size("tokens")).select("line", F.xxhash64("leaf", F.coalesce(F.size("fixed"), F.lit(0)), "fixed").alias("template"))


def dropped_lines(documents: DataFrame) -> DataFrame:
    """d_id, d_hash and the numbers, from 0, of the lines that go, of each document (d_id, d_hash, text) that has some."""
    narrow = staged(_lines(documents), "line-hashes").where("judged")
    ends = [F.min(_here()).alias("first"), F.max(_here()).alias("last"), F.count(F.lit(1)).alias("rows")]
    met = narrow.groupBy("line").agg(*ends).where("first != last")  # in two documents
    same = staged(met.select("line", "first", "rows"), "line-recurring")

    tree = narrow.where(F.col("leaf").isNotNull())
    leaves = tree.groupBy("leaf").agg(*ends, F.min("line").alias("low"), F.max("line").alias("high")).where("first != last AND low != high")
    leaves = staged(leaves.select("leaf", "rows"), "line-leaves")  # others can't make a template that is no equal line
    inside = staged(spread_join(tree, leaves, ["leaf"], "rows", "left_semi").select(*_DOCUMENT, "no", "line", "leaf"), "line-leaf-lines")
    made = templates(staged(_different(documents, inside), "line-different"))
    made = staged(made.join(inside.groupBy("line").agg(F.count(F.lit(1)).alias("rows")), "line"), "line-templates")
    matched = staged(spread_join(inside, made, ["line"], "rows").select(*_DOCUMENT, "no", "template"), "line-matched")
    once = matched.groupBy("template", *_DOCUMENT).agg(F.count(F.lit(1)).alias("rows"))
    general = once.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min(_here()).alias("first"), F.sum("rows").alias("rows"))
    general = staged(general.where(F.col("n_docs") >= TEMPLATE_DOCS).drop("n_docs"), "line-general")

    out = [spread_join(rows, known, [key], "rows").where(~_here().eqNullSafe(F.col("first"))).select(*_DOCUMENT, "no") for rows, known, key in ((narrow.select(*_DOCUMENT, "no", "line"), same, "line"), (matched, general, "template"))]
    return out[0].unionByName(out[1]).groupBy(*_DOCUMENT).agg(F.collect_set("no").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and text (the lines that stay) of each row."""
    documents = docs.select(F.col(id_col).alias("d_id"), text_of(text_col).alias("text")).withColumn("d_hash", text_hash(F.col("text")))
    joined = _with(documents, dropped_lines(documents), "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return joined.select(F.col("d_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
