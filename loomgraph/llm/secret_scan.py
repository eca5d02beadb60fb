"""Secret scanning with an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its text. The ledger records which (blob, rule version)
pairs have been scanned and what was found; a run scans only the pairs it has not seen, one copy of each, and joins the
findings back to all the paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored, unused


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case, free of Unicode case folding."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` (0: the match) has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kinds in their listed order. A longest run of fewer characters than {n,} asks for can't hold a match of its own, so
#: the lengths of access and hex stand in the pattern; assign must consume matches that are too short.
RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
RULE_VERSION = "1"
LEDGER_SCHEMA = "blob binary, rule_version string, spans array<struct<start:long,kind_no:int,end:long,kind:string>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _lengths(text: str, rule: Rule) -> Column:
    """Per match, in order: characters since the last one, of the match, and of the group that must be long enough."""
    whole = F.lit(rf"(?s)\G(.*?)({rule.pattern})")  # \G: a tail without matches is gone through once
    of = lambda group: F.transform(F.regexp_extract_all(text, whole, F.lit(group)), lambda x: F.length(x).cast("long"))
    found = F.arrays_zip(of(1).alias("gap"), of(2).alias("size"), of(2 + rule.group).alias("tested"))
    return F.when(F.col(text).rlike(rule.pattern), found)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs (blob, text; one row each or repeated ones) in which a rule matches."""
    kinds = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(i).alias("kind_no"), F.lit(r.least).alias("least"), _lengths("text", r).alias("found")) for i, r in enumerate(rules)))
    hits = blobs.select("blob", F.explode(kinds).alias("k")).where("k.found is not null and size(k.found) > 0")
    each = hits.select("blob", "k.kind", "k.kind_no", "k.least", F.posexplode("k.found").alias("no", "m")).dropDuplicates(["blob", "kind_no", "no"])
    before = Window.partitionBy("blob", "kind_no").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(before)).where("m.tested >= least")
    span = F.struct((F.col("end") - F.col("m.size")).alias("start"), "kind_no", "end", "kind")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks. ``versions``: path columns of any kind plus doc_id and text.

    Returns the rows to append to the ledger (blob, rule_version, spans; spans is empty where nothing was found) and
    (doc_id, blob) of all versions. A null text is the empty text; repeated rows share one scan; a null doc_id is a
    path like any other; an empty table adds nothing.
    """
    rows = versions.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    paths = stored(rows.select("doc_id", "blob"), "blob-paths")
    first = paths.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("at"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    texts = rows.withColumn("at", F.coalesce("doc_id", F.lit(-1))).join(first, ["at", "blob"]).select("blob", "text")
    found = scan(texts, rules)
    fresh = first.select("blob").join(found, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
    return stored(fresh, "ledger"), paths


def findings(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """(doc_id, blob, spans) of every version: the ledger, brought up to date, joined back to all paths.

    Spans are (start, kind_no, end, kind) in code points, end exclusive, ordered by start and the rules' order.
    """
    fresh, paths = update_ledger(versions, ledger, rules, rule_version)
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule_version") == rule_version))
    hits = known.where("size(spans) > 0").select("blob", "spans")
    out = spread_join(paths, hits, "blob", ["doc_id"], "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(hits.schema["spans"].dataType))).select("doc_id", "blob", "spans")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        head = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when((s["start"] >= acc["at"]), F.concat(head, F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    tail = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(text)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in their texts replaced by their kind; n_chars, where there is one, follows.

    A null text stays null; repeated rows, null ids and other columns, whatever their names, stay as they are. An empty
    table gives no rows.
    """
    blob, spans = unused("blob", docs.columns), unused("spans", docs.columns)
    hits = findings(docs).where("size(spans) > 0").groupBy(F.col("blob").alias(blob)).agg(F.first("spans").alias(spans))
    named = docs.withColumn(blob, blob_of(F.coalesce(F.col("text"), F.lit(""))))
    found = F.col(spans).isNotNull()
    out = spread_join(named, stored(hits, "hits"), blob, ["doc_id"], "left")
    out = out.withColumn("text", F.when(found, redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
