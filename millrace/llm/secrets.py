"""Secret scans: patterns, and sliding-window Shannon entropy per character class. Native DataFrame code only.

Base spans are matches of three patterns, leftmost and non-overlapping for each kind, without those that are too short. Added
spans come from candidate strings of a character class: a window moves along each candidate, one count goes down and one goes
up with each step, and the sum of n * log2(n) over the counts follows from the table of its whole-number values. Windows with
enough entropy join to spans. What base spans cover is cut out of them, and so are matches of the allow-list (see ALLOW) with up to
REACH characters of the same token before and after; pieces of at least LEAST_PIECE characters stay. Candidates right after a word
of ALLOW_BEFORE are left out whole.

Null and empty texts have no spans. The work for a text grows with its length, whatever it holds. Repeated rows give equal
rows, ids may be null, an empty table gives an empty result, and columns besides id and text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
#: kind: pattern, group that is measured, least length. Fixed values of the contract.
BASE = {
    "assign": (rf"""(?:{_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are runs of at least `window` characters of `alphabet` that hold all of `needs`."""

    kind: str
    run: str
    alphabet: str
    needs: tuple[str, ...]
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"{self.run}{{{self.window},}}"

    @property
    def table(self) -> list[int]:
        """n * log2(n) in millionths, for n up to the window."""
        return [0] + [round(n * math.log2(n) * 1e6) for n in range(1, self.window + 1)]

    @property
    def most(self) -> int:
        """The sum of n * log2(n), in millionths, that the entropy `bits` allows."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * 1e6)


CLASSES = (
    EntropyClass("entropy_hex", "[0-9A-Fa-f]", "0123456789ABCDEFabcdef", ("[0-9]", "[A-Fa-f]"), 20, 3.0),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", ("[0-9]", "[A-Z]", "[a-z]"), 24, 4.0),
    EntropyClass("entropy_lower", "[0-9a-z]", "0123456789abcdefghijklmnopqrstuvwxyz", ("[0-9]", "[a-z]"), 24, 3.6),
    EntropyClass("entropy_upper", "[0-9A-Z]", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("[0-9]", "[A-Z]"), 24, 3.6),
)
#: What is no secret: UUIDs, alphabets in order, placeholders. It speaks for REACH characters around it, but not beyond its token.
ALLOW = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|0123456789|abcdefghij|ABCDEFGHIJ|example|EXAMPLE|placeholder|PLACEHOLDER|dummy|DUMMY|xxxx+|XXXX+"
REACH, LEAST_PIECE, TOKEN = 24, 8, "[A-Za-z0-9+/_-]"
#: Words right before a candidate that name it a digest of public data.
ALLOW_BEFORE = r"(?:sha1|sha256|sha384|sha512|md5|integrity|checksum|commit)[:= -]{1,3}$"

#: Strings that a base span covers whole, so that no added span is left.
ALL_BASE = f"^[0-9a-f]{{{BASE['hex'][2]},}}$"

SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"
KINDS = [*BASE, *(c.kind for c in CLASSES)]


#: Steps of one fold at most. Spark copies a fold's state at each step, so long arrays are folded in blocks.
BLOCK = 128


def _let(value: Column, then) -> Column:
    """then(value), with value made once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _ints() -> Column:
    return F.array().cast("array<int>")


def _running(values: Column) -> Column:
    """The sums up to each of the whole numbers, itself included."""

    def fold(items: Column, size) -> Column:
        """For each item, the sum of the sizes before it, and at last that of all."""
        zero = F.struct(F.lit(0).alias("at"), _ints().alias("all"))
        return F.aggregate(items, zero, lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: F.concat(acc["all"], F.array(acc["at"])))

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK)), lambda b: F.slice(fold(F.slice(v, b + 1, BLOCK), lambda x: x), 2, BLOCK))
        return _let(blocks, lambda local: F.flatten(F.zip_with(local, F.slice(fold(local, lambda x: F.element_at(x, -1)), 1, F.size(local)), lambda x, o: F.transform(x, lambda y: y + o))))

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(_ints()))


def _pieces(text: Column, pattern: str, of) -> Column:
    """What `of` makes of (match, text before it since the last match, text after it up to the next one, start), for each match of
    the pattern, in order.

    The text is split at the matches, so starts are sums of lengths in code points.
    """
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.split(text, pattern, -1).alias("gap"))
    found = _let(found, lambda z: F.transform(F.filter(z, lambda x: x["hit"].isNotNull()), lambda x, i: F.struct(x["hit"].alias("hit"), x["gap"].alias("gap"), F.get(z, i + 1)["gap"].alias("after"))))

    def placed(all_: Column) -> Column:
        upto = _running(F.transform(all_, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        return F.zip_with(all_, upto, lambda x, end: F.struct(x["hit"].alias("hit"), x["gap"].alias("gap"), x["after"].alias("after"), (end - F.length(x["hit"])).alias("start")))

    return F.transform(_let(found, placed), of)


def _span(kind: str, start: Column, end: Column) -> Column:
    place = KINDS.index(kind) if kind in KINDS else len(KINDS)
    return F.struct(start.cast("int").alias("start"), F.lit(place).alias("place"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    whole = pattern if kind == "assign" else pattern.replace("+)", f"{{{least - 4 if kind == 'access' else least},}})")  # a run's only match is the whole run, so short runs may be passed over
    spans = _pieces(text, whole, lambda m: F.struct(_span(kind, m["start"], m["start"] + F.length(m["hit"])).alias("span"), F.length(F.regexp_extract(m["hit"], pattern, group)).alias("size")))
    kept = F.transform(F.filter(spans, lambda s: s["size"] >= least), lambda s: s["span"])
    return F.when(text.rlike(whole), kept).otherwise(F.array().cast(SPAN))


#: Counts stand in long numbers, so many in one, of so many bits each: a window has fewer characters than 2 ** COUNT_BITS.
COUNTS, COUNT_BITS = 12, 5


def _codes(hit: Column, c: EntropyClass) -> Column:
    """For each character of hit, where its count stands."""

    def place(code: int) -> str:
        word, bit = divmod(code, COUNTS)
        return f"struct({code} AS code, {word} AS word, {bit * COUNT_BITS} AS bit, {1 << bit * COUNT_BITS}L AS one)"

    places = F.expr(f"array({', '.join(place(k) for k in range(len(c.alphabet)))})")
    chars = F.filter(F.split(hit, ""), lambda ch: ch != "")
    return F.transform(chars, lambda ch: F.element_at(places, F.instr(F.lit(c.alphabet), ch)))


def _entropy_windows(hit: Column, c: EntropyClass) -> Column:
    """(a, b) of the joined windows of hit whose entropy is at least c.bits.

    The window begins anew with each block of places, so that no fold is longer than a block and a window.
    """
    values, w = c.table, c.window
    step_of = F.expr(f"array({', '.join(str(b - a) for a, b in zip(values, values[1:]))})")  # what the sum gains with the n-th equal character
    nothing = F.expr("struct(-1 AS code, -1 AS word, 0 AS bit, 0L AS one)")
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(c.alphabet) // COUNTS)).alias("n"), F.lit(0).alias("sum"), F.lit(0).alias("at"), _ints().alias("starts"))

    def count(acc: Column, place: Column) -> Column:
        word = F.call_function("shiftright", F.element_at(acc["n"], place["word"] + 1), place["bit"])
        return word.bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")

    def ended(acc: Column) -> Column:
        """The starts with that of the window that ends at acc.at, if it has the entropy."""
        return F.when((acc["at"] < w) | (acc["sum"] > c.most), acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"] - w)))

    def step(acc: Column, m: Column) -> Column:
        come, go = m["come"], m["go"]
        gone = F.when(go["word"] >= 0, F.element_at(step_of, count(acc, go))).otherwise(0)
        here = F.element_at(step_of, count(acc, come) + F.when(come["code"] == go["code"], 0).otherwise(1))
        counts = F.transform(acc["n"], lambda v, i: v + F.when(i == come["word"], come["one"]).otherwise(0) - F.when(i == go["word"], go["one"]).otherwise(0))
        return F.struct(counts.alias("n"), (acc["sum"] - gone + here).alias("sum"), (acc["at"] + 1).alias("at"), ended(acc).alias("starts"))

    def block(codes: Column) -> Column:
        moves = F.zip_with(codes, F.slice(F.concat(F.array_repeat(nothing, w), codes), 1, F.size(codes)), lambda i, o: F.struct(i.alias("come"), o.alias("go")))
        return F.aggregate(moves, zero, step, ended)

    def starts(codes: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(codes) - w, F.lit(BLOCK)), lambda b: F.transform(_let(F.slice(codes, b + 1, BLOCK + w - 1), block), lambda x: x + b))
        return F.flatten(each)

    def joined_windows(x: Column) -> Column:
        begins = F.filter(x, lambda s, i: (i == 0) | (s - F.get(x, i - 1) > w))
        lasts = F.filter(x, lambda s, i: (i == F.size(x) - 1) | (F.get(x, i + 1) - s > w))
        return F.zip_with(begins, lasts, lambda a, z: F.struct(a.alias("a"), (z + w).alias("b")))

    some = F.size(F.array_distinct(F.split(hit, ""))) >= math.ceil(2**c.bits)  # fewer kinds can't reach the entropy
    return F.when(some, _let(_let(_codes(hit, c), starts), joined_windows)).otherwise(F.array())


def entropy_spans(text: Column, c: EntropyClass) -> Column:
    """Joined windows of the candidates of a class whose entropy is at least c.bits."""

    def one(m: Column) -> Column:
        candidate = reduce(lambda x, y: x & y, [m["hit"].rlike(n) for n in c.needs]) & ~m["hit"].rlike(ALL_BASE)
        spans = F.transform(_entropy_windows(m["hit"], c), lambda s: _span(c.kind, m["start"] + s["a"], m["start"] + s["b"]))
        return F.when(candidate & ~m["gap"].rlike(ALLOW_BEFORE), spans).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(c.pattern), F.flatten(_pieces(text, c.pattern, one))).otherwise(F.array().cast(SPAN))


def allowed_spans(text: Column) -> Column:
    """What matches of the allow-list cover, with up to REACH characters of their token before and after them."""

    def one(m: Column) -> Column:
        before = F.length(F.regexp_extract(F.right(m["gap"], F.lit(REACH)), f"{TOKEN}*$", 0))
        after = F.length(F.regexp_extract(F.left(m["after"], F.lit(REACH)), f"^{TOKEN}*", 0))
        return _span("allow", m["start"] - before, m["start"] + F.length(m["hit"]) + after)

    return F.when(text.rlike(ALLOW), _pieces(text, ALLOW, one)).otherwise(F.array().cast(SPAN))


def uncovered(spans: Column, cover: Column, least: int = LEAST_PIECE) -> Column:
    """Begins and ends (a, b) of what of the spans, which don't meet each other, no span of cover meets, of at least `least`
    characters.

    Where nothing but spans is open follows from the sums of begins and ends in order.
    """

    def both(s: Column, opens: int, covers: int) -> Column:
        return F.array(*[F.struct(s[c].alias("pos"), F.lit(sign * opens).alias("open"), F.lit(sign * covers).alias("over")) for c, sign in (("start", 1), ("end", -1))])

    def free(events: Column) -> Column:
        inside = F.zip_with(_running(F.transform(events, lambda e: e["open"])), _running(F.transform(events, lambda e: e["over"])), lambda o, v: (o > 0) & (v == 0))
        return F.zip_with(events, inside, lambda e, f: F.struct(e["pos"].alias("pos"), f.alias("free")))

    def pieces(x: Column) -> Column:
        each = F.transform(x, lambda e, i: F.struct(e["pos"].alias("a"), F.get(x, i + 1)["pos"].alias("b"), e["free"].alias("free")))
        return F.transform(F.filter(each, lambda e: e["free"] & (e["b"] - e["a"] >= least)), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b")))

    events = F.sort_array(F.concat(F.flatten(F.transform(spans, lambda s: both(s, 1, 0))), F.flatten(F.transform(cover, lambda s: both(s, 0, 1)))))
    alone = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))
    return F.when((F.size(spans) == 0) | (F.size(cover) == 0), alone).otherwise(_let(_let(events, free), pieces))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans of each row: arrays of (start, place, end, kind) in order of start, then kind as listed.

    Starts and ends are in code points, ends exclusive. base has the patterns' spans, spans has all.
    """
    found = _found(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))
    return found.select("doc_id", "base", F.sort_array(F.concat("base", "added")).alias("spans"))


_made: dict[int, tuple[list[Column], Column, Column]] = {}


def _columns() -> tuple[list[Column], Column, Column]:
    """base and the candidates' spans, of a column text; what covers them; what is added. They are some ten thousand calls of the JVM to
    make, so they are made once for it."""
    jvm = id(SparkContext._gateway)
    if jvm not in _made:
        text = F.col("text")
        some = reduce(lambda x, y: x | y, [F.size(c.kind) > 0 for c in CLASSES])
        first = [F.sort_array(F.concat(*[base_spans(text, k) for k in BASE])).alias("base"), *[entropy_spans(text, c).alias(c.kind) for c in CLASSES]]
        cover = F.when(some, F.concat("base", allowed_spans(text))).otherwise(F.array().cast(SPAN))
        _made[jvm] = first, cover, F.concat(*[_added(c.kind) for c in CLASSES]).alias("added")
    return _made[jvm]


def _found(rows: DataFrame) -> DataFrame:
    """doc_id, text, base and added spans of rows of doc_id and text."""
    first, cover, added = _columns()
    return rows.select("doc_id", "text", *first).withColumn("cover", cover).select("doc_id", "text", "base", added)


def _added(kind: str) -> Column:
    return F.transform(uncovered(F.col(kind), F.col("cover")), lambda x: _span(kind, x["a"], x["b"]))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with each run of overlapping spans replaced by mask."""
    found = _found(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))).withColumn("spans", F.sort_array(F.concat("base", "added")))
    whole = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))
    found = found.withColumn("stay", uncovered(F.array(whole), F.col("spans"), 1))
    parts = F.transform("stay", lambda x: F.substring(F.col("text"), x["a"] + 1, x["b"] - x["a"]))
    first, last = F.coalesce(F.get("stay", F.lit(0))["a"], F.lit(1)) > 0, F.try_element_at("stay", F.lit(-1))["b"] < F.length("text")
    cleaned = F.concat(F.when(first, mask).otherwise(""), F.array_join(parts, mask), F.when(last, mask).otherwise(""))
    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(cleaned).alias("text"))
