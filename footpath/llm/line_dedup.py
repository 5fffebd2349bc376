"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are duplicates if they are equal or within the edit bound (a character replaced, put in or left out is an
edit; short lines have the bound 0); a line goes if a duplicate stands earlier (smaller ``doc_id``, or before in the same
document).  Judged on the input, not on what is left.

Equal lines meet by a 128-bit hash, aggregated before the shuffle.  For the bound 1 a line's neighbourhood is
the line without one of its characters: equal variants at the same place are a replacement, a variant
equal to a whole line is an insertion.  Emitting a variant per character of every line would be too much,
so the part that may differ is narrowed first: one edit leaves one half of a line alone, so only lines that
share a half with a different line can have a partner, and the other half is halved again until it has at
most ``WINDOW`` characters.  That loses nothing: at each step the longer length of a pair settles where both
are cut, and a line is cut for either case.  Windows of a pair may be ``WINDOW`` and ``WINDOW + 1`` long; so the latter
give variants as well as being halved again.  Equal variants are joined through the earliest line of each, not as
pairs; the edit distance is verified on the texts.

For greater bounds (``far_lines``) a neighbourhood is all a line's variants with up to as many characters left out or marked as replaced, of
whole lines; so it grows with the line's length to the power of the bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Characters of a window whose variants are emitted.
WINDOW = 32

#: Characters from which on a line, spaces at the ends apart, may differ from a duplicate; shorter ones must be equal.
EDIT_CHARS = 16

#: Up to so many lines with a shared half (16 bytes each) are broadcast to fetch their texts; beyond, they
#: are shuffled with the texts.
BROADCAST_ROWS = 500_000


def _cuts(n: Column, key: Column, text: Column) -> Column:
    """Array of (key, window): the text cut in halves for a longer length of n or n + 1."""
    half = lambda x: F.floor(x / 2).cast("int")
    left = F.transform(
        F.array_distinct(F.array(half(n), half(n + 1))),
        lambda q: F.struct(F.xxhash64(key, F.lit(0), F.right(text, q)).alias("key"), F.left(text, n - q).alias("window")),
    )
    right = F.transform(
        F.array_distinct(F.array(half(n + 1), half(n) + 1)),
        lambda w: F.struct(F.xxhash64(key, F.lit(1), F.left(text, w)).alias("key"), F.substring(text, w + 1, n).alias("window")),
    )
    return F.concat(left, right)


def _takes_part(line: Column) -> Column:
    """Lines that aren't blank."""
    return line.rlike("[^ \\t\\n\\x0B\\f\\r]")


def _may_differ(line: Column, edit_chars: int) -> Column:
    return F.length(F.trim(line)) >= edit_chars


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that take part: ``doc_id, pos, line, h, h2``."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.where(_takes_part(F.col("line")))
    return rows.withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key another line has as well."""
    often = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    return rows.join(materialize(often, "shared-keys"), "key")  # written, so that the join can split hot keys


def near_lines(docs: DataFrame, distinct: DataFrame, edit_chars: int = EDIT_CHARS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hashes ``h, h2`` of the distinct lines that an earlier, different line is one edit away from.

    ``distinct``: ``h, h2, first`` (doc_id, pos) and ``keys``, the hashes of a line's halves."""
    halves = _shared(distinct.select("h", F.explode("keys").alias("key")))
    chosen = materialize(halves.select("h").distinct(), "half-shared")
    lines = _lines(docs).where(_may_differ(F.col("line"), edit_chars))
    few = chosen.count() <= broadcast_rows
    texts = lines.join(F.broadcast(chosen) if few else chosen, "h").select("doc_id", "pos", "line", "h", "h2")
    # of a line's places only the first counts
    texts = texts.join(distinct.select("h", "h2", "first"), ["h", "h2"]).where("doc_id = first.doc_id and pos = first.pos")
    texts = materialize(texts.select("h", "h2", "first", "line"), "half-shared-lines")
    rows = texts.select("h", "first", F.lit(0).cast("long").alias("key"), F.col("line").alias("window"))
    ready = None
    while True:
        rows = rows.select("h", "first", F.inline(_cuts(F.length("window"), F.col("key"), F.col("window"))))
        rows = materialize(_shared(rows), "windows")
        done = rows.where(F.length("window") <= WINDOW + 1)  # one more, as its partner may end here
        ready = done if ready is None else ready.unionByName(done)
        rows = rows.where(F.length("window") > WINDOW)
        if rows.isEmpty():  # a window is halved each time
            break
    n = F.length("window")
    without = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.struct(i.alias("at"), F.concat(F.left("window", i - 1), F.substring(F.col("window"), i + 1, n)).alias("v")),
    )
    without = F.when(n > 0, without).otherwise(F.slice(without, 1, 0))
    variant = F.concat(
        F.transform(without, lambda x: F.struct(F.xxhash64("key", n, x["at"], x["v"]).alias("variant"), F.lit(0).alias("role"))),
        F.transform(without, lambda x: F.struct(F.xxhash64("key", F.lit("-"), x["v"]).alias("variant"), F.lit(1).alias("role"))),
        F.array(F.struct(F.xxhash64("key", F.lit("-"), "window").alias("variant"), F.lit(2).alias("role"))),
    )
    variants = materialize(ready.select("h", "first", F.inline(variant)).distinct(), "variants")
    mine = F.struct("first", "h")
    best = variants.groupBy("variant").agg(*(F.min(F.when(F.col("role") == r, mine)).alias(f"best{r}") for r in range(3)))
    best = best.where("best0 is not null or (best1 is not null and best2 is not null)")
    other = F.when(F.col("role") == 0, F.col("best0")).when(F.col("role") == 1, F.col("best2")).otherwise(F.col("best1"))
    pairs = variants.join(materialize(best, "earliest"), "variant").withColumn("other", other)
    pairs = pairs.where("other is not null and other.h <> h and other.first < first").select("h", F.col("other.h").alias("other_h")).distinct()
    earlier = texts.select(F.col("h").alias("other_h"), F.col("line").alias("other_line"))
    verified = pairs.join(texts, "h").join(earlier, "other_h").where(F.levenshtein("line", "other_line", 1) == 1)
    return verified.select("h", "h2").distinct()


def far_lines(distinct: DataFrame, max_edits: int) -> DataFrame:
    """Hashes ``h, h2`` of the lines of the written table ``distinct(h, h2, first, line)`` that an earlier, different line is at most
    ``max_edits`` edits away from.

    A variant leaves out or marks characters from left to right.  Two lines are within the bound if and only if variants
    with marks at the same places are equal, where marks and what both leave out are at most ``max_edits`` together."""
    n = F.length("rest")
    rows = distinct.select("h", "first", F.lit("").alias("made"), F.col("line").alias("rest"), F.lit(0).alias("out"), F.lit(0).alias("marks"), F.lit("").alias("where"))
    variants = rows
    for _ in range(max_edits):
        at = F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("at")
        rows = rows.select("h", "first", "made", "rest", "out", "marks", "where", at)
        before, after = F.concat("made", F.left("rest", F.col("at") - 1)), F.substring("rest", F.col("at") + 1, F.length("rest"))
        left_out = F.struct(before.alias("made"), after.alias("rest"), (F.col("out") + 1).alias("out"), F.col("marks").alias("marks"), F.col("where").alias("where"))
        place = F.concat("where", F.lit(","), F.length(before).cast("string"))
        marked = F.struct(F.concat(before, F.lit("?")).alias("made"), after.alias("rest"), F.col("out").alias("out"), (F.col("marks") + 1).alias("marks"), place.alias("where"))
        rows = rows.select("h", "first", F.inline(F.array(left_out, marked)))
        variants = variants.unionByName(rows)
    variants = variants.select("h", "first", "out", F.col("marks").alias("m"), F.xxhash64("where", F.concat("made", "rest")).alias("v"), F.xxhash64(F.lit(7), "where", F.concat("made", "rest")).alias("v2")).distinct()
    variants = materialize(variants, "variants")
    mine = F.struct("first", "h")
    best = variants.groupBy("v", "v2").agg(F.count("*").alias("n"), *(F.min(F.when(F.col("out") <= k, mine)).alias(f"best{k}") for k in range(max_edits + 1))).where("n > 1")
    met = variants.join(materialize(best, "earliest"), ["v", "v2"])
    room = F.lit(max_edits) - F.col("m") - F.col("out")
    other = reduce(lambda found, k: F.when(room == k, F.col(f"best{k}")).otherwise(found), range(max_edits + 1), F.lit(None))
    gone = met.withColumn("other", other).where("other.h <> h and other.first < first").select("h").distinct()
    return distinct.join(materialize(gone, "far"), "h", "left_semi").select("h", "h2")


def kept_lines(docs: DataFrame, max_edits: int = 1, edit_chars: int = EDIT_CHARS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, kept``: positions of the lines of a document that take part and stay."""
    lines = _lines(docs)
    first = F.min(F.struct("doc_id", "pos")).alias("first")
    may_differ = _may_differ(F.col("line"), edit_chars)
    if max_edits == 0:
        kept = lines.groupBy("h", "h2").agg(first)
    elif max_edits == 1:
        keys = F.transform(_cuts(F.length("line"), F.lit(0).cast("long"), F.col("line")), lambda x: x["key"])
        # fixed in number (3 to 4), so that they go along with the hash; missing ones are null
        rows = lines.select("h", "h2", "doc_id", "pos", F.when(may_differ, keys).alias("keys"))
        rows = rows.select("h", "h2", "doc_id", "pos", *(F.get("keys", F.lit(i)).alias(f"k{i}") for i in range(4)))
        distinct = rows.groupBy("h", "h2").agg(first, *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)))
        distinct = distinct.select("h", "h2", "first", F.array_compact(F.array("k0", "k1", "k2", "k3")).alias("keys"))
        distinct = materialize(distinct, "lines")
        kept = distinct.join(near_lines(docs, distinct, edit_chars, broadcast_rows), ["h", "h2"], "left_anti")
    else:
        distinct = materialize(lines.groupBy("h", "h2").agg(first, F.min("line").alias("line")), "lines")
        kept = distinct.join(far_lines(distinct.where(may_differ), max_edits), ["h", "h2"], "left_anti")
    return kept.select("first.*").groupBy("doc_id").agg(F.collect_list("pos").alias("kept"))


def dedup_lines(docs: DataFrame, max_edits: int = 1, edit_chars: int = EDIT_CHARS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``text`` without duplicate lines, and ``n_lines`` and ``n_removed``.

    ``max_edits`` is the edit bound of lines of at least ``edit_chars`` characters, spaces at the ends apart (0: of none); shorter lines are
    duplicates of equal ones only.  Lines end at line feeds; blank ones always stay.
    A null text stays null (0 lines), an empty text has one
    empty line.  Rows with a null ``doc_id`` stay as they are and are no source of duplicates; rows
    that share a ``doc_id`` are taken as one place and judged alike.  Other columns go along (but for
    ``n_lines`` and ``n_removed``, which are replaced); an empty table gives an empty result.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    kept_doc, kept_at, lines, gone = fresh(own, "kept_doc", "kept", "lines", "gone")
    kept = kept_lines(docs.select("doc_id", "text"), max_edits, edit_chars, broadcast_rows)
    kept = materialize(kept.select(F.col("doc_id").alias(kept_doc), F.col("kept").alias(kept_at)), "kept")
    rows = docs.select(*own).join(kept, F.col("doc_id") == F.col(kept_doc), "left").withColumn(lines, F.split("text", "\n", -1))
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    judged = F.filter(at, lambda i: _takes_part(F.get(F.col(lines), i)))
    none = F.array().cast("array<int>")
    dropped = F.when(F.col("doc_id").isNull(), none).otherwise(F.array_except(judged, F.coalesce(kept_at, none)))
    rows = rows.withColumn(gone, F.when(F.col(lines).isNotNull(), dropped))
    stay = F.transform(F.array_except(at, gone), lambda i: F.get(F.col(lines), i))
    text = F.when(F.size(gone) > 0, F.array_join(stay, "\n")).otherwise(F.col("text"))
    n = F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return rows.select(*(text.alias(c) if c == "text" else F.col(c) for c in own), n.alias("n_lines"), removed.alias("n_removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of every document, those removed and a digest of the rest; see ``dedup_lines`` for special cases."""
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Lines of 16 characters or more that are one edit apart share their first or their last eight.
ORACLE = """
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from documents
), j as (
  select * from l where regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
), e as (
  select line, length(line) as n, min(struct_pack(d := doc_id, p := pos)) as first from j group by line
), f as (
  select * from e where length(trim(line, ' ')) >= 16
), near as (
  select distinct a.line from f a join f b on left(a.line, 8) = left(b.line, 8) and abs(a.n - b.n) <= 1 and b.first < a.first and a.line <> b.line
  where levenshtein(a.line, b.line) <= 1
  union
  select distinct a.line from f a join f b on right(a.line, 8) = right(b.line, 8) and abs(a.n - b.n) <= 1 and b.first < a.first and a.line <> b.line
  where levenshtein(a.line, b.line) <= 1
), k as (
  select l.doc_id, l.pos, l.line,
         e.line is null or (e.first.d = l.doc_id and e.first.p = l.pos and near.line is null) as stays
  from l left join e on e.line = l.line left join near on near.line = l.line
)
select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (stays), '')) as kept_sha256
from k group by doc_id
"""
