"""Secret scanning with an incremental, content-addressed blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger is a Parquet table with one row for each (blob, rule
version) that was ever scanned, with its findings. A scan takes the blobs of the given versions that the ledger lacks, each
once however many paths hold it, scans them, and appends; findings then join back to all paths. The one exchange of whole
texts is the one that brings equal blobs together; it costs far less than the scans that it saves.

Spans are found by one replacement for each rule: a matching text is marked with two sentinels and split at them. Only the
lengths of the parts go on, one row for each, and a running sum over a text's parts gives the offsets, so the work is in
proportion to the matches. Offsets count code points, ends are exclusive. The sentinels cannot occur in the text, because
a replacement of equal length removes them first; no rule can match the character put in their place.

Every rule is linear in the text and has no bound on what it matches. None is matched by recursion, so a text of any length
and content is scanned in bounded stack. A web token's rule has a second form for the JVM, whose matcher would read a long
run without a dot again from every beginning in it: a beginning that fails has read its run to the end, so that no other of
the same run can succeed, and the form goes over each run once. DuckDB's matcher is linear and takes the plain one.

A null text counts as empty; a text without findings has an empty ``spans`` and the digest of no spans. Repeated rows and
equal texts get the same findings; an empty table gives no rows and adds nothing to the ledger. Only the id and text
columns are read, so other columns may have any names; ``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, written

OPEN, CLOSE = "\ue000", "\ue001"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; ``group`` of each must have ``least`` code points or more."""

    kind: str
    pattern: str
    group: int
    least: int
    #: A plain filter that every text with a match passes. It is what a scan mostly does, so it begins with classes, which
    #: pass over most places of a text in one step, and not with a choice between words, which the matcher tries one by one.
    needs: str
    #: The same matches as group 2, behind what the matcher passes over as group 1.
    once: str = ""


# The three base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"[pstaPSTA][aeopAEOP](?i:ssword|sswd|cret|ken|i_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
)
EXTRA = (
    Rule("bearer", r"(?:ghp|gho|ghs|glpat|sk|xoxb|xoxp)[_-][A-Za-z0-9_-]+", 0, 24, "[gsx][hlko](?:[pos]|pat|x[bp])?[_-][A-Za-z0-9_-]{10}"),
    Rule(
        "webtoken", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 24, "eyJ[A-Za-z0-9_-]",
        r"((?<![A-Za-z0-9_-])(?:(?!eyJ[A-Za-z0-9_-])[A-Za-z0-9_-])*+)(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)",
    ),
    # No repeated group: the JVM matches those by recursion.
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----", 0, 1, "-----BEGIN "),
)
RULES = BASE + EXTRA
RULE_VERSION = "3"
PARTS = "array<struct<rank:int,place:int,size:int,match:int,measured:int>>"
SPAN = "struct<kind:string,start:int,end:int,rank:int>"
LEDGER = f"blob string, rule_version string, findings array<{SPAN}>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _parts(text: Column, rule: Rule, rank: int) -> Column:
    """(rank, place, size, match, measured) of each part between the matches of a rule: code points of the part, of the
    match at its beginning (none: place 0), and of the match's measured group. Empty where the rule cannot match."""
    marked = F.split(F.regexp_replace(text, rule.once or rule.pattern, f"$1{OPEN}$2{CLOSE}" if rule.once else f"{OPEN}$0{CLOSE}"), OPEN)

    def measures(part: Column, place: Column) -> Column:
        match = F.substring_index(part, CLOSE, 1)
        group = F.length(F.regexp_extract(match, rule.pattern, rule.group)) if rule.group else F.length(match)
        own = F.length(part) - F.when(place > 0, 1).otherwise(0)  # without the closing sentinel
        return F.struct(F.lit(rank).alias("rank"), place.alias("place"), own.alias("size"), F.length(match).alias("match"), group.alias("measured"))

    return F.when(text.rlike(rule.needs), F.transform(marked, measures)).otherwise(F.array().cast(PARTS))


def found_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of distinct (blob, _text): all spans, ordered by start and then by the order of the rules."""
    clean = F.replace(F.replace("_text", F.lit(OPEN), F.lit("\x01")), F.lit(CLOSE), F.lit("\x01"))
    # In a projection of its own: a generator evaluates its input anew for each mention.
    cleaned = blobs.select("blob", clean.alias("_text"))
    parts = cleaned.select("blob", F.explode_outer(F.concat(*[_parts(F.col("_text"), rule, i) for i, rule in enumerate(rules)])).alias("_p")).select("blob", "_p.*")
    before = Window.partitionBy("blob", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.sum("size").over(before).cast("int"))
    kind, least = (F.array(*[F.lit(getattr(r, x)) for r in rules])[F.col("rank")] for x in ("kind", "least"))
    span = F.struct("start", "rank", (F.col("start") + F.col("match")).alias("end"), kind.alias("kind"))
    ordered = F.array_sort(F.collect_list(F.when((F.col("place") > 0) & (F.col("measured") >= least), span)))
    out = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))
    return placed.groupBy("blob").agg(out.alias("findings"))


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """Ledger rows for the blobs of ``versions`` that ``ledger`` lacks under ``rule_version``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(blob_id(text).alias("blob"), text.alias("_text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    return found_spans(blobs.dropDuplicates(["blob"]), rules).select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger stored at ``path``; None before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per path with blob and findings, the ledger with what was new).

    ``ledger_path`` names a stored ledger in place of ``ledger``; it is made if it is not there. What is new is appended to
    it (else, written apart) before the join, which deals both of its sides itself, so that adaptive execution can split a
    blob that very many paths share. One scan at a time may append to a stored ledger.
    """
    spark = versions.sparkSession
    path = ledger_path or shared_path(spark, "ledger")
    before = open_ledger(spark, ledger_path) if ledger_path else ledger
    scan_blobs(versions, before, rules, rule_version, text_col).write.mode("append").parquet(path)
    whole = open_ledger(spark, path)
    if ledger is not None and not ledger_path:
        whole = ledger.select(*whole.columns).unionByName(whole)
    paths = versions.select(F.col(id_col), blob_id(F.coalesce(F.col(text_col), F.lit(""))).alias("blob"))
    current = whole.filter(F.col("rule_version") == rule_version)
    return paths.join(current, "blob", "left").select(id_col, "blob", "rule_version", "findings"), whole


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with every secret replaced by ``mask``; the other columns stay. Overlapping spans of several kinds are
    covered by one mask; matches too short to count stay, as they do in the scan."""
    new = written(scan_blobs(docs, text_col=text_col), "ledger").filter(F.size("findings") > 0)
    spans = new.select("blob", F.explode("findings").alias("_s")).select("blob", "_s.*")
    if kinds is not None:
        spans = spans.filter(F.col("kind").isin(*kinds))
    before = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    reached = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    gap = F.when(F.col("start") >= F.col("from"), F.struct("from", F.col("start").alias("to")))
    gaps = reached.groupBy("blob").agg(F.array_sort(F.collect_list(gap)).alias("_gaps"), F.max("end").alias("_last"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"), blob_id(F.coalesce(F.col(text_col), F.lit(""))).alias("_blob"))
    # Four bytes for each code point, so that a piece is cut without counting from the beginning; bound by a lambda, so
    # that it is made once for a text.
    wide = F.transform(F.array(F.encode("_text", "UTF-32")), lambda t: _cut_and_mask(t, mask))[0]
    clean = F.when(F.col("_gaps").isNotNull() & F.col("_text").isNotNull(), wide).otherwise(F.col("_text"))
    joined_rows = rows.join(gaps.withColumnRenamed("blob", "_found"), F.col("_blob") == F.col("_found"), "left")
    return joined_rows.select(*[clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def _cut_and_mask(wide: Column, mask: str) -> Column:
    """The pieces of a text in UTF-32 before each secret (``_gaps``) and behind the last, with a mask between any two."""
    piece = lambda start, size: F.decode(F.substring(wide, start * 4 + 1, size * 4), "UTF-32")
    return F.concat(F.array_join(F.transform("_gaps", lambda g: F.concat(piece(g["from"], g["to"] - g["from"]), F.lit(mask))), ""), piece(F.col("_last"), F.octet_length(wide)))
