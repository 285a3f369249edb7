"""Secret scans: located candidates, and how widely the corpus has copied each of them.

Only DataFrame functions: Catalyst evaluates every expression. Matches are located without a
position function: ``split`` by the pattern gives the pieces between matches and
``regexp_extract_all`` the matches, so begins are running sums of their lengths in code points,
first within runs of ``RUN`` pieces and then over runs.
Texts without a needle of the pattern (a plain substring test) skip the regular expression.

Ownership frequency: every candidate value is hashed, counted by distinct (value, repository,
owner) first and by value after that, so a value copied into a third of the corpus is
pre-aggregated before it meets in one task, and its occurrences learn its owners in as many tasks
as shuffles have. A value that more than ``max_owners`` owners hold is
a widely copied example; one that fewer hold and that looks random is live. The method's own
spans are of kind ``owned``: long mixed tokens outside the base kinds which at most
``max_owners`` owners hold.

Defined results: null text is empty and has no span; a null owner or repository counts as one
of its own; repeated rows are scanned each on their own; an empty table gives no rows; extra
columns pass through ``keep`` only, and one called ``spans`` comes back as ``spans_kept``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import join_spread, kept_struct, workspace, written

# The base patterns, in listed order, with the least length of the named group.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "owned": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
ORDER = list(PATTERNS)
BASE = ORDER[:3]
NEEDLES = ("password", "passwd", "secret", "token", "apikey", "api_key")
MAX_OWNERS = 2
#: Pieces of a text whose matches are gathered into one array before arrays are joined.
RUN = 256


def _worth(kind: str, text: Column) -> Column:
    """A cheap test that any text with a span of the kind passes."""
    if kind == "assign":
        low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        out = low.contains(NEEDLES[0])
        for needle in NEEDLES[1:]:
            out = out | low.contains(needle)
        return out
    if kind == "access":
        return text.contains("AKIA")
    return text.rlike("[0-9a-f]{24}" if kind == "hex" else PATTERNS[kind][0])


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<begin, end, value>> of the kind's matches that are long enough."""
    pattern, group, least = PATTERNS[kind]
    # Greedy runs of one class: a run that is too short can hold no longer match.
    quick = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}.get(kind, pattern)
    whole = F.regexp_extract_all(text, F.lit(quick), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(quick), F.lit(group))
    gaps = F.split(text, quick, -1)
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), values.alias("value"))
    empty = F.array().cast("array<struct<begin:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        found = F.struct(begin.alias("begin"), end.alias("end"), x["value"].alias("value"))
        return F.struct(
            F.coalesce(end, begin).alias("at"),
            F.when(F.length(x["value"]) >= least, F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"),
        )

    def run(part: Column) -> Column:
        """(length of the pieces, matches among them counted from the first)."""
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), empty.alias("found")), step)

    def moved(x: Column, by: Column) -> Column:
        return F.transform(x["found"], lambda m: F.struct((m["begin"] + by).alias("begin"), (m["end"] + by).alias("end"), m["value"].alias("value")))

    def joined(runs: Column) -> Column:
        ends = F.aggregate(runs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return F.flatten(F.zip_with(runs, F.slice(ends, 1, F.size(runs)), moved))

    def located(pieces: Column) -> Column:
        # Runs of RUN pieces: growing one array match by match would copy it for each.
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / RUN).cast("int")), lambda k: run(F.slice(pieces, k * RUN + 1, F.lit(RUN))))
        return _once(runs, joined)

    return F.when(_worth(kind, text), _once(rows, located)).otherwise(empty)


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashed(rank: int, spans: Column) -> Column:
    def one(x: Column) -> Column:
        mixed = x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
        return F.struct(x["begin"].alias("begin"), F.lit(rank).alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash"), mixed.alias("mixed"))

    return F.transform(spans, one)


def candidates(docs: DataFrame, keep: list[str], repository: Column, owner: Column) -> DataFrame:
    """kept (a struct of keep), repository, owner and the array ``spans`` of (begin, rank of kind, end, hash, mixed) of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.concat(*[_hashed(k, spans_of(kind, text)) for k, kind in enumerate(ORDER)])
    return docs.select(kept_struct(docs, keep), repository.alias("repository"), owner.alias("owner"), spans.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories and owners of every candidate value over the corpus."""
    once = found.select("repository", "owner", F.explode("spans").alias("s")).groupBy(F.col("s.hash").alias("hash"), "repository", "owner").agg(F.count(F.lit(1)).alias("copies"))
    null = F.lit("\0")
    return once.groupBy("hash").agg(
        F.countDistinct(F.coalesce("repository", null)).alias("repositories"),
        F.countDistinct(F.coalesce("owner", null)).alias("owners"),
        F.sum("copies").alias("copies"),
    )


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, repository: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS) -> DataFrame:
    """keep, spans (begin, kind, end, hash, owners, verdict) in order of begin then kind, for each document.

    verdict: example (copied by more than max_owners owners), live (few owners, and letters of
    both cases or long hex), or weak.
    """
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    repository = F.col("source") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    found = candidates(docs, keep, repository.cast("string"), owner.cast("string")).withColumn("row", F.monotonically_increasing_id())
    found = written(found, f"{workspace(spark, 'secrets')}/candidates")
    each = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s", F.col("s.hash").alias("hash"))
    held = join_spread(each, ownership(found), ["hash"], "row")
    strong = F.col("s.mixed") | F.col("s.kind").isin(ORDER.index("access"), ORDER.index("hex"))
    verdict = F.when(F.col("owners") > max_owners, "example").when(strong, "live").otherwise("weak")
    held = held.where((F.col("s.kind") < len(BASE)) | ((F.col("owners") <= max_owners) & F.col("s.mixed")))
    item = F.struct(
        F.col("s.begin").alias("begin"), F.col("s.kind").alias("rank"), F.col("s.end").alias("end"),
        F.element_at(F.array(*map(F.lit, ORDER)), F.col("s.kind") + 1).alias("kind"), "hash", "owners", "repositories", verdict.alias("verdict"),
    )
    whole = held.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("spans"))
    empty = F.array().cast(whole.schema["spans"].dataType)
    kept = [F.col("kept")[c].alias("spans_kept" if c == "spans" else c) for c in keep]
    return found.select("kept", "row").join(whole, "row", "left").select(*kept, F.coalesce("spans", empty).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(docs)
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long")
    verdicts = lambda v: F.size(F.filter(base, lambda x: x["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), verdicts("example").alias("n_example"), verdicts("live").alias("n_live"),
    )
