"""Secret scan with multipart credential linking, in DataFrame functions only.

Base detectors report what is strong by itself. Weak parts (a 40-character
secret-like string, a service endpoint, a short key identifier) mean nothing
alone: they are reported only where complementary parts meet within a scope.
The link is an interval join inside the row. Spans of one kind never overlap,
so sorted by start they are sorted by end too, and the complements nearest to a
weak part on either side are found by binary search; positions come from running
sums by doubling. A text of n parts takes n log n steps. A text is scanned whole,
and rows never leave their partition, so a hot source or a long text adds no
shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in Java syntax.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
# Weak parts: reported only next to a complementary part.
IDENTIFIER = r"(?<![A-Za-z0-9])(?:(?:AC|SK)[0-9a-f]{32}|(?:client|account|tenant|access)_id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{4,})"
SECRET = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"
KINDS = (*BASE, "identifier", "secret", "endpoint")
SCOPE = 400


def _scan(x: Column, add) -> Column:
    """Running results of add over an array of longs, first to each element: every round reaches twice as far back."""
    reach = F.array(*(F.lit(1 << k) for k in range(31)))
    return F.aggregate(reach, x, lambda acc, r: F.when(r < F.size(acc), F.transform(acc, lambda v, i: F.when(i >= r, add(v, F.get(acc, i - r))).otherwise(v))).otherwise(acc))


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start,end,rank,kind>> in code points of all leftmost matches that do not overlap.

    Spark gives matches but no positions: the pieces between the matches come
    from a split at the same pattern, so an end is the length of all up to it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    piece = F.split(text, pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if least else found
    rank = KINDS.index(kind)
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,rank:int,kind:string>>)")
    sizes = F.zip_with(found, F.slice(piece, 1, F.size(found)), lambda m, p: (F.length(m) + F.length(p)).cast("long"))
    rows = F.zip_with(F.zip_with(_scan(sizes, lambda a, b: a + b), found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"))), kept, lambda s, g: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(g).alias("inner")))
    spans = F.transform(F.filter(rows, lambda x: x["inner"] >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)


def _until(spans: Column, at: Column) -> Column:
    """How many spans of a sorted array start at ``at`` or before: binary search."""
    powers = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when(F.coalesce(F.get(spans, n + p - 1)["start"] <= at, F.lit(False)), n + p).otherwise(n))


def _near(part: Column, spans: Column, scope: int) -> Column:
    """Is part within scope code points of one of the sorted spans of a kind? The last that starts no later and the next one tell."""
    return F.exists(
        F.array(_until(spans, part["start"])),
        lambda n: F.coalesce(F.get(spans, n - 1)["end"] >= part["start"] - scope, F.lit(False)) | F.coalesce(F.get(spans, n)["start"] <= part["end"] + scope, F.lit(False)),
    )


def _covered(part: Column, spans: Column) -> Column:
    """Does part share a code point with one of the sorted spans of a kind?"""
    return F.coalesce(F.get(spans, _until(spans, part["end"] - 1) - 1)["end"] > part["start"], F.lit(False))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, base: str = "base_spans", links: str = "linked_spans") -> DataFrame:
    """Every input column and row, plus the columns base and links (arrays of start, end, rank, kind).

    Null text counts as empty; a row without finds has empty arrays. Input
    columns of those two names are replaced. Positions are code points, end
    exclusive; arrays are ordered by start, then by kind as listed in KINDS.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn(base, F.array_sort(F.concat(_spans(text, ASSIGN, "assign", 1, 6), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))))
    # one pass over the text decides whether weak parts can matter; most texts stop here
    weak = F.array_sort(F.concat(_spans(text, IDENTIFIER, "identifier"), _spans(text, SECRET, "secret"), _spans(text, ENDPOINT, "endpoint")))
    empty = F.slice(F.col(base), 1, 0)
    maybe = F.regexp_like(text, F.lit(f"{IDENTIFIER}|{SECRET}")) | (F.size(base) > 0)
    found = found.withColumn("_weak", F.when(maybe, weak).otherwise(empty))
    # every kind by itself, computed once a row and bound to a name
    one = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind).alias(kind)
    sides = F.struct(*(one(F.col(base), k) for k in BASE), *(one(F.col("_weak"), k) for k in KINDS[len(BASE) :]), F.col("_weak").alias("weak"))

    def linked(s: Column, by: Column) -> Column:
        any_of = lambda *kinds: functools.reduce(lambda a, b: a | b, (_near(s, by[k], scope) for k in kinds))
        names, keys = any_of("access", "identifier"), any_of("assign", "hex", "secret")
        clear = ~functools.reduce(lambda a, b: a | b, (_covered(s, by[k]) for k in BASE))
        return clear & F.when(s["kind"] == "identifier", keys).when(s["kind"] == "secret", names).otherwise(names & keys)

    near = F.transform(F.array(sides), lambda by: F.filter(by["weak"], lambda s: linked(s, by)))[0]
    return found.withColumn(links, F.when(F.size("_weak") > 0, near).otherwise(empty)).drop("_weak")


#: Code points of a piece of text that redaction cuts from.
PIECE = 4096


def _cut(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end of a text given as pieces of PIECE code points."""
    first = F.floor(begin / PIECE).cast("int")
    n = (F.floor((end - 1) / PIECE) - first + 1).cast("int")
    return F.when(end > begin, F.substring(F.array_join(F.slice(pieces, first + 1, F.greatest(n, F.lit(0))), ""), (begin % PIECE + 1).cast("int"), (end - begin).cast("int"))).otherwise("")


def redact(scanned: DataFrame, text_col: str = "text", base: str = "base_spans", links: str = "linked_spans") -> DataFrame:
    """Replace every span of scan_secrets by [kind]; overlapping spans become one. Drops the span columns.

    Null text stays null; n_chars, where present, is set to the new length.
    """
    spans = F.array_sort(F.concat(base, links))
    text = F.col(text_col)
    whole = F.struct(spans.alias("spans"), F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)).alias("pieces"), F.length(text).cast("long").alias("size"))
    reach = lambda t: _scan(F.transform(t["spans"], lambda s: s["end"]), F.greatest)

    def part(t: Column, s: Column, done: Column) -> Column:
        """What stands between the spans so far and s, then s's label; nothing for a span that overlaps them."""
        return F.when(s["start"] >= done, F.concat(_cut(t["pieces"], done, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")

    def clean_text(t: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), reach(t))  # ends of all spans before each, then of all
        parts = F.transform(F.arrays_zip(t["spans"].alias("s"), F.slice(before, 1, F.size(t["spans"])).alias("d")), lambda x: part(t, x["s"], x["d"]))
        return F.concat(F.array_join(parts, ""), _cut(t["pieces"], F.element_at(before, -1), t["size"]))

    clean = F.when(F.size(spans) > 0, F.transform(F.array(whole), clean_text)[0]).otherwise(text)
    out = scanned.withColumn(text_col, clean).drop(base, links)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in out.columns else out


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Base and linked spans of every document."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in BASE),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base_spans", "linked_spans"))).alias("spans"),
    )
