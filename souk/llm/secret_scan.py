"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Base kinds, each leftmost and non-overlapping within its kind:

* ``assign``: a keyword, ``:`` or ``=``, and a value of 12 or more characters,
* ``access``: ``AKIA`` and capitals or digits, 18 or more characters,
* ``hex``: lower-case hex digits, 16 or more.

The method adds ``token``: runs of 20 or more of ``A-Za-z0-9_-`` that mix
capitals, small letters and digits and touch no base span. How widely a value
is spread over the whole corpus decides what it is: its hash is counted by
distinct owners and, where the table names repositories (``repo_col``), by
distinct repositories. A value of at least ``min_owners`` owners, or of several
owners and at least ``min_repos`` repositories, is a copied example; any other
looks live, so a value of one owner does, however many documents hold it. Base
spans always stay, with their verdict; ``token`` spans are reported only while
their value looks live.

Positions come from splitting a text at the matches: a match starts after the
lengths of all earlier pieces and matches. Only value hashes and span records
are shuffled. Distinct counts combine first by (value, owner) and (value,
repository), so a value that stands everywhere spreads over all tasks; the
join back is salted by the row.

Defined cases: a NULL text is empty and has no spans; a NULL owner or
repository counts as one more owner or repository; NULL ids are kept; repeated
rows each give a row and count once; an empty table gives no rows; other
columns of the input are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import digest128, stored

ASSIGN = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "token")
MIN_VALUE = 12
SALTS = 16


@dataclass(frozen=True)
class Spread:
    min_owners: int = 3   # a value of so many owners is a copied example
    min_repos: int = 10   # ... or one of several owners and so many repositories


CHUNK = 256   # items that are worked on at once, so that no array is copied per item
SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(items: Column) -> Column:
    """The array cut into arrays of at most ``CHUNK`` items."""
    return bound(items, lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(x, c * CHUNK + 1, CHUNK)))


def running_max(items: Column) -> Column:
    """The largest of the items so far, for each item (an array of int)."""
    empty = F.array().cast("array<int>")

    def inside(chunk: Column) -> Column:
        return F.aggregate(chunk, empty, lambda acc, x: F.array_append(
            acc, F.greatest(x, F.get(acc, F.size(acc) - 1))))

    zero = F.struct(F.lit(0).alias("top"), F.array().cast("array<array<int>>").alias("out"))
    done = F.aggregate(F.transform(chunks(items), inside), zero, lambda acc, c: F.struct(
        F.greatest(acc["top"], F.get(c, F.size(c) - 1)).alias("top"),
        F.array_append(acc["out"], F.transform(c, lambda x: F.greatest(x, acc["top"]))).alias("out")),
        lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(items) > 0, done).otherwise(empty)


def count_up_to(sorted_items: Column, x: Column) -> Column:
    """How many of the sorted items are not above ``x``, by halving."""
    zero = F.struct(F.lit(0).alias("low"), F.size(sorted_items).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = F.get(sorted_items, middle) <= x
        return F.when(acc["low"] >= acc["high"], acc).otherwise(F.struct(
            F.when(right, middle + 1).otherwise(acc["low"]).alias("low"),
            F.when(right, acc["high"]).otherwise(middle).alias("high")))

    rounds = F.ceil(F.log2(F.size(sorted_items) + 2.0)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), rounds), zero, halve, lambda acc: acc["low"])


def _spans(text: Column, kind: int, pattern: str) -> Column:
    """Array of (start, kind, end, match) of every match of ``pattern``."""
    whole, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                       x["match"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(acc["found"], one).alias("found"))

    def moved(found: Column, by: Column) -> Column:
        return F.transform(found, lambda x: F.struct(
            (x["start"] + by).alias("start"), x["kind"].alias("kind"), (x["end"] + by).alias("end"),
            x["match"].alias("match")))

    zipped = F.filter(F.arrays_zip(pieces.alias("piece"), whole.alias("match")),
                      lambda x: x["match"].isNotNull())
    # places inside a chunk of matches, then each chunk moved behind those before it
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    inside = F.transform(chunks(zipped), lambda c: F.aggregate(c, zero, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
    found = F.aggregate(inside, none, lambda acc, c: F.struct(
        (acc["at"] + c["at"]).alias("at"), F.array_append(acc["found"], moved(c["found"], acc["at"])).alias("found")),
        lambda acc: F.flatten(acc["found"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _apart(tokens: Column, base: Column) -> Column:
    """Tokens that share no character with a span of ``base`` (sorted by start)."""
    starts = F.transform(base, lambda b: b["start"])
    tops = running_max(F.transform(base, lambda b: b["end"]))

    def free(t: Column, b: Column) -> Column:
        return bound(count_up_to(b["starts"], t["start"]), lambda n: ~(
            F.coalesce(F.get(b["tops"], n - 1) > t["start"], F.lit(False))
            | F.coalesce(F.get(b["starts"], n) < t["end"], F.lit(False))))

    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(bound(
        F.struct(starts.alias("starts"), tops.alias("tops")), lambda b: F.filter(tokens, lambda t: free(t, b))))


def _value(x: Column) -> Column:
    return F.when(x["kind"] == 0, F.regexp_extract(x["match"], ASSIGN, 1)).otherwise(x["match"])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per document with all candidate spans and value hashes (stored)."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"),
                       _repo(repo_col).alias("repo"), F.coalesce(text_col, F.lit("")).alias("text"))
    each = read.select(
        "doc_id", "owner", "repo", *row_digest("doc_id", "text", "owner", "repo"),
        F.filter(_spans(F.col("text"), 0, ASSIGN), lambda x: F.length(_value(x)) >= MIN_VALUE
                 ).alias("assign"),
        _spans(F.col("text"), 1, ACCESS).alias("access"),
        _spans(F.col("text"), 2, HEX).alias("hex"),
        F.filter(_spans(F.col("text"), 3, TOKEN), lambda x: x["match"].rlike("[0-9]")
                 & x["match"].rlike("[a-z]") & x["match"].rlike("[A-Z]")).alias("token"))
    based = each.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    both = based.withColumn("found", F.concat("base", _apart(F.col("token"), F.col("base"))))
    hashed = F.transform("found", lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"),
        *digest128("value", _value(x))))
    return stored(both.select("doc_id", "row_a", "row_b", "owner", "repo",
                              hashed.alias("found")), "secret-spans")


def _repo(repo_col: str | None) -> Column:
    return F.lit(None).cast("string") if repo_col is None else F.col(repo_col)


def row_digest(id_col: str = "doc_id", text_col: str = "text",
               owner_col: str = "source", repo_col: str | None = None) -> list[Column]:
    """The digest by which ``scan`` names a row, from the row's own columns."""
    return digest128("row", F.col(id_col), F.col(owner_col), _repo(repo_col),
                     F.coalesce(text_col, F.lit("")))


def value_spread(found: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(value, n_owners, n_repos, copied) over the whole corpus."""
    held = found.select("owner", "repo", F.explode("found").alias("x")).select(
        F.struct("owner").alias("owner"), F.struct("repo").alias("repo"),
        "x.value_a", "x.value_b")
    counted = held.groupBy("value_a", "value_b").agg(
        F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"))
    return counted.withColumn("copied", (F.col("n_owners") >= spread.min_owners)
                              | (F.col("n_owners") > 1) & (F.col("n_repos") >= spread.min_repos))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         owner_col: str = "source", repo_col: str | None = None,
         spread: Spread = Spread()) -> DataFrame:
    """Per document: its spans with their verdicts, by start and kind."""
    found = find_spans(docs, id_col, text_col, owner_col, repo_col)
    salted = value_spread(found, spread).withColumn("salt", F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = (found.where(F.size("found") > 0).dropDuplicates(["row_a", "row_b"])
            .select("row_a", "row_b", F.explode("found").alias("x"))
            .select("row_a", "row_b", "x.*", F.pmod("row_b", F.lit(SALTS)).cast("int").alias("salt")))
    judged = (each.join(salted, ["value_a", "value_b", "salt"])
              .where((F.col("kind") < 3) | ~F.col("copied"))
              .groupBy("row_a", "row_b")
              .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "copied")))
                   .alias("spans")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,copied:boolean>>")
    return (found.select("doc_id", "row_a", "row_b").join(judged, ["row_a", "row_b"], "left")
            .withColumn("spans", F.coalesce("spans", empty)))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span (overlapping ones as one) replaced by ``mark``.

    Kept is what lies between the end of all spans so far and the next start beyond
    it. The text is cut once per ``CHUNK`` of such gaps, and each gap from that cut.
    """
    def pieces(x: Column) -> Column:
        gaps = F.filter(F.transform(x["spans"], lambda s, i: F.struct(
            F.coalesce(F.get(x["tops"], i - 1), F.lit(0)).alias("begin"), s["start"].alias("end"))),
            lambda g: g["begin"] <= g["end"])

        def cut(chunk: Column) -> Column:
            base = F.get(chunk, F.lit(0))["begin"]
            last = F.get(chunk, F.size(chunk) - 1)["end"]
            return bound(F.struct(F.substring(text, base + 1, last - base).alias("text"), base.alias("base"),
                                  chunk.alias("gaps")), lambda c: F.array_join(F.transform(
                                      c["gaps"], lambda g: F.concat(F.substring(
                                          c["text"], g["begin"] - c["base"] + 1, g["end"] - g["begin"]), F.lit(mark))), ""))

        end = F.get(x["tops"], F.size(x["tops"]) - 1)
        return F.concat(F.array_join(F.transform(chunks(gaps), cut), ""),
                        F.substring(text, end + 1, F.length(text)))

    tops = running_max(F.transform(spans, lambda x: x["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(
        bound(F.struct(spans.alias("spans"), tops.alias("tops")), pieces))
