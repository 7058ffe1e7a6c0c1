"""Pages, mail addresses, licence lines and turns of conversations, by regular expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..tables import table

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LINK = r"""(?i)<a[ \t\r\n][^>]*?href="([^"]*)\""""
#: What a page holds besides its text, in the order in which it goes.
UNSEEN = [r"(?s)<!--.*?-->", *[rf"(?is)<{tag}[^>]*>.*?</{tag}>" for tag in ("script", "style", "nav", "title")]]
TAG, BLANK = r"(?s)<[^>]*>", r"[ \t\r\n]+"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z][A-Za-z]+"
LICENSE = r"(?i)licen[cs]e|copyright|all rights reserved"


def decoded(text: Column) -> Column:
    """The common entities of HTML as characters; & last, so that nothing is decoded twice."""
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def seen(html: Column) -> Column:
    """A page without comments, scripts, styles, navigation and title: a </p> in a script ends nothing."""
    for pattern in UNSEEN:
        html = F.regexp_replace(html, pattern, " ")
    return html


def page_text_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(seen(html), TAG, " ")), BLANK, " "))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _seen_sql() -> str:
    out = "html"
    for pattern in UNSEEN:
        out = f"regexp_replace({out}, {_quoted(pattern)}, ' ', 'g')"
    return out


def _decoded_sql(text: str) -> str:
    for entity, character in ENTITIES:
        text = f"replace({text}, {_quoted(entity)}, {_quoted(character)})"
    return text


@query(f"SELECT page_id, trim({_decoded_sql(f'regexp_extract(html, {_quoted(TITLE)}, 1)')}) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.trim(decoded(F.regexp_extract("html", TITLE, 1))).alias("title"))


@query(f"SELECT page_id, i AS no, {_decoded_sql('found[i]')} AS href FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), {_quoted(LINK)}, 1) AS found FROM pages), unnest(range(1, len(found) + 1)) AS u(i)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links outside comments, navigation included, numbered in order."""
    html = F.regexp_replace("html", UNSEEN[0], " ")
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("no", "href"))
    return found.select("page_id", (F.col("no") + 1).cast("long").alias("no"), decoded(F.col("href")).alias("href"))


@query(f"SELECT page_id, trim(regexp_replace({_decoded_sql(f'''regexp_replace({_seen_sql()}, {_quoted(TAG)}, ' ', 'g')''')}, {_quoted(BLANK)}, ' ', 'g')) AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", page_text_of(F.col("html")).alias("text"))


@query(f"SELECT doc_id, len(found) AS n, array_to_string(found, ' ') AS addresses FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(MAIL)}) AS found FROM documents) WHERE len(found) > 0")
def doc_email_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(MAIL), F.lit(0))
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", found.alias("found")).where(F.size("found") > 0)
    return rows.select("doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", " ").alias("addresses"))


@query(f"SELECT doc_id, i AS no, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i) WHERE regexp_matches(lines[i], {_quoted(LICENSE)})")
def doc_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").where(F.col("text").rlike(LICENSE)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(F.col("line").rlike(LICENSE)).select("doc_id", (F.col("no") + 1).cast("long").alias("no"), "line")


@query("SELECT conv_id, turn, role, lag(role) OVER w AS last_role, count(*) OVER (PARTITION BY conv_id) AS turns, sum(length(text)) OVER w::BIGINT AS chars_so_far, coalesce(role = lag(role) OVER w, false) AS same_speaker FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conv_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the speaker before, the number of turns, the characters so far, and whether one speaks twice in a row."""
    every, so_far = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn")
    last = F.lag("role").over(so_far)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", last.alias("last_role"), F.count(F.lit(1)).over(every).alias("turns"), F.sum(F.length("text")).over(so_far).alias("chars_so_far"), F.coalesce(F.col("role") == last, F.lit(False)).alias("same_speaker")
    )
