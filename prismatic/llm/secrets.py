"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Base spans come from three fixed patterns. Further candidates are long mixed runs of letters and digits. Every candidate value's hash is counted over the
whole corpus by distinct owners and distinct repositories: a value that several owners hold, or that is spread over more than `max_repos` repositories
of one, is a widely copied example; one that stays with at most `max_owners` owners and `max_repos` repositories looks live, and its bare
occurrences are added as spans of kind "owner". How many documents hold it plays no part.

Null text counts as empty and has no span. Offsets are code points, ends exclusive. Positions come from the pieces between matches by a
doubling prefix sum, so a text with many matches costs n log n. A null owner or repository counts as one of its own. Repeated rows each get a
row. An empty table gives none.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, skew_join

# The patterns of the base spans.
ASSIGN = "(?=[PpSsTtAa])(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24}[0-9a-f]*+"
#: A text without any of these strings has no match; finding that out is much cheaper than the pattern.
NEEDS = {ASSIGN: ("=", ":"), ACCESS: ("AKIA",)}
#: Method's candidates: a run of 20 or more such characters, with a letter and a digit.
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "owner"]
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
MASK = "[SECRET]"


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it: as the one cell of an array, it is bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column, by=lambda a, b: a + b) -> Column:
    """Inclusive prefix sums (or maxima) of an array of int, none under 0: at each step every cell adds the one 1, 2, 4, ... places before it."""

    def summed(x: Column) -> Column:
        steps = once(F.size(x), lambda n: F.filter(F.array(*[F.lit(1 << k) for k in range(26)]), lambda s: s < n))
        return F.aggregate(steps, x, lambda x, s: F.zip_with(x, F.concat(F.array_repeat(F.lit(0), s), F.slice(x, 1, F.size(x) - s)), by))

    return once(lengths, summed)


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of the pattern in text, leftmost and non-overlapping, as SPANS; value is the given group. A text without a match is read once by the pattern, others twice."""

    def spans(found: Column) -> Column:
        # what stands before each match
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda p: F.char_length(p))
        own = F.zip_with(gaps, found, lambda g, m: F.struct((g + F.char_length(m)).alias("step"), F.char_length(m).alias("own"), (F.regexp_extract(m, pattern, group) if group else m).alias("value")))

        def placed(x: Column) -> Column:
            return F.zip_with(x, running(F.transform(x, lambda r: r["step"])), lambda r, e: F.struct((e - r["own"]).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), r["value"].alias("value")))

        return F.when(F.size(found) > 0, once(own, placed)).otherwise(F.array().cast(SPANS))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if pattern in NEEDS:
        found = F.when(functools.reduce(Column.__or__, (text.contains(x) for x in NEEDS[pattern])), found).otherwise(F.array().cast("array<string>"))
    return once(found, spans).cast(SPANS)


def listed(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def row_key(text: Column, doc_id: Column, owner: Column, repo: Column) -> Column:
    """Equal for repeated rows, else different."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.sha2(F.concat_ws("\x00", part(doc_id.cast("string")), part(owner), part(repo), text).cast("binary"), 256)


def inputs(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), text.alias("text"))
    return rows.withColumn("row", row_key(F.col("text"), F.col("doc_id"), F.col("owner"), F.col("repo")))


def scanned(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of each row of inputs(), written to the shared folder."""
    text = F.col("text")
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.char_length(s["value"]) >= 6)
    more = F.filter(matches(text, CANDIDATE, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    base = F.concat(F.col("a"), F.col("k"), F.col("h"))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("value")))
    found = docs.select("doc_id", "row", "owner", "repo", assign.alias("a"), matches(text, ACCESS, 1).alias("k"), matches(text, HEX, 2).alias("h"), more.alias("m"))
    return materialize(found.select("doc_id", "row", "owner", "repo", *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))], hashed(base).alias("base"), hashed(F.col("m")).alias("more")), "secrets-spans")


def ownership(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with a row for each, owners and repositories of each value's hash). Tasks reduce to distinct owners before the shuffle."""
    each = materialize(found.where(F.size("base") + F.size("more") > 0).select("row", "owner", "repo", F.explode(F.concat("base", "more")).alias("c")).select("row", "owner", "repo", "c.*").distinct(), "secrets-candidates")
    places = each.select("value", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    repos = places.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return each, repos.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def judged(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, max_owners: int = 1, max_repos: int = 2) -> tuple[DataFrame, DataFrame]:
    """(inputs, a row for each of them: base and added spans, and how many of the spans look live or are examples)."""
    owner = F.col("source") if owner is None else owner
    rows = inputs(docs, owner, F.concat_ws("/", owner, F.col("lang")) if repo is None else repo)
    found = scanned(rows)
    each, values = ownership(found)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    span = F.struct("start", "kind", "end", "value")
    verdicts = skew_join(each, values, ["value"]).groupBy("row").agg(F.collect_list(F.when(live & (F.col("kind") == 3), span)).alias("added"), F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(~live, 1)).alias("n_example"))
    out = skew_join(found, verdicts, ["row"], "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:bigint>>")
    added = F.coalesce("added", none)
    return rows, out.select("doc_id", "row", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat(F.col("base"), added)).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def masked(text: Column, spans: Column) -> Column:
    """text with what its spans (as listed()) hold replaced, overlapping ones as one."""
    pairs = F.transform(F.split(spans, ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end")))

    def rebuilt(code_points: Column, each: Column) -> Column:
        """code_points has four bytes each, so that any piece is cut out at once."""
        before = F.concat(F.array(F.lit(0)), running(F.transform(each, lambda s: s["end"]), lambda a, b: F.greatest(a, b)))
        # the mark goes in decoding; without it a text's own would
        cut = lambda a, n: F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring(code_points, 4 * a + 1, 4 * n)), "UTF-32")
        # the last cell has no span: it is what follows the spans
        piece = lambda s, b: F.when(s.isNull(), cut(b, F.octet_length(code_points))).when(s["start"] >= b, F.concat(cut(b, s["start"] - b), F.lit(MASK))).otherwise("")
        return F.array_join(F.zip_with(each, before, piece), "")

    found = once(F.struct(F.encode(text, "UTF-32").alias("t"), F.array_sort(pairs).alias("e")), lambda x: rebuilt(x["t"], x["e"]))
    return F.when(spans == "", text).otherwise(found)
