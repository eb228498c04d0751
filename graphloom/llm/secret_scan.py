"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is addressed by its content. The ledger
holds the pairs of blob and rule version that have been scanned; a scan reads
only blobs of pairs it doesn't hold, one copy each, and findings are joined
back to all paths of the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind: its leftmost non-overlapping matches whose ``group`` has ``least`` characters.

    ``hint`` is a cheap pattern that a text with a match always has. ``added``
    marks rules beyond the base set.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None
    added: bool = False


#: The base patterns, and added ones for well-known token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", added=True, hint="-----BEGIN "),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", added=True, hint="eyJ"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}", added=True, hint="gh[pousr]_"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", added=True, hint="xox[abprs]-"),
)
RULE_VERSION = "1"
#: Matches whose positions are added up in one run.
RUN = 256
SPAN = "struct<kind:string,nth:int,start:int,end:int,added:boolean>"


def spans_of(text: Column, rule: Rule, nth: int) -> Column:
    """All spans of a rule in a text, in code points, ends exclusive.

    The text is split at all matches; the lengths of the parts between and of
    the matches add up to the positions, within runs of ``RUN`` matches first
    and then from run to run, so that work grows with the matches of a text.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), judged.alias("j")), lambda b, m: F.struct(
        F.length(b).alias("gap"), F.length(m["w"]).alias("size"), F.length(m["j"]).alias("judged")))
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def walk(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        span = F.struct(F.lit(rule.kind).alias("kind"), F.lit(nth).alias("nth"), start.alias("start"), (start + step["size"]).alias("end"), F.lit(rule.added).alias("added"))
        found = F.when(step["judged"] >= rule.least, F.array_append(state["found"], span)).otherwise(state["found"])
        return F.struct((start + step["size"]).alias("at"), found.alias("found"))

    def run_of(steps: Column, i: Column) -> Column:
        return F.aggregate(F.slice(steps, i * RUN + 1, RUN), F.struct(F.lit(0).alias("at"), none.alias("found")), walk)

    def moved(span: Column, by: Column) -> Column:
        return F.struct(span["kind"].alias("kind"), span["nth"].alias("nth"), (span["start"] + by).alias("start"), (span["end"] + by).alias("end"), span["added"].alias("added"))

    def join_run(state: Column, run: Column) -> Column:
        part = F.transform(run["found"], lambda s: moved(s, state["at"]))
        return F.struct((state["at"] + run["at"]).alias("at"), F.array_append(state["parts"], part).alias("parts"))

    def positions(steps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda i: run_of(steps, i))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("parts"))
        return F.when(F.size(steps) == 0, none).otherwise(F.flatten(F.aggregate(runs, start, join_run)["parts"]))

    # a one-element array binds the steps once for all runs
    spans = F.transform(F.array(steps), positions)[0]
    return F.when(text.rlike(rule.hint or rule.pattern), spans).otherwise(none)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans) of (blob, text): spans of all rules by start, then by the rules' order."""
    parts = [spans_of(F.col("text"), r, i) for i, r in enumerate(rules)]
    spans = F.array_sort(
        F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["nth"].alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"), s["added"].alias("added")))
    )
    return blobs.select("blob", spans.alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text", rules=RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) of all versions of texts by path.

    ``findings`` has one row for each version: path, blob, spans. ``ledger``
    is the given one (blob, rule_version, spans; null: none yet) with the newly
    scanned pairs; only blobs without a pair of this rule version are scanned.
    A null text is an empty blob; a null path is a path like others; repeated
    versions give repeated findings; an empty table gives empty results; other
    columns are ignored. Rules judge whole texts of any length.
    """
    rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    names = rows.select("path", "blob")
    # one path of each blob stands for it: the least, so null only where no other is
    unseen = names.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    unseen = materialize(unseen)
    wanted = unseen.select(F.col("blob").alias("b"), F.col("path").alias("p"))
    texts = rows.join(wanted, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi").select("blob", "text")
    fresh = materialize(scan_blobs(texts, rules).withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version", "spans"))
    # a version repeated with its path is scanned as often; one of its equal findings counts
    fresh = fresh.dropDuplicates(["blob", "rule_version"]) if _repeats(fresh) else fresh
    grown = fresh if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(fresh)
    known = grown.where(F.col("rule_version") == rule_version).select("blob", "spans")
    return names.join(known, "blob").select("path", "blob", "spans"), grown


def _repeats(scanned: DataFrame) -> bool:
    n, distinct = scanned.select("blob").groupBy("blob").count().agg(F.sum("count"), F.count(F.lit(1))).first()
    return n is not None and n > distinct


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per version: key, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return findings.select(
        F.col("path").alias(key), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
