"""Secret scans over an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its text.  The
ledger lists the (blob, rule version) pairs that were scanned before; only
unseen pairs are scanned, each distinct text once, and findings are joined back
to every path (document) that holds the blob.  A changed rule is a new rule
version, so it is applied to old blobs too.

Everything is DataFrame expressions.  A match's place follows from the lengths
of the pieces between matches, counted in code points.

A first scan starts with an empty ledger; pass the ledger and the findings of the
step before, as stored tables, for the next one.

Cases: a null text counts as empty and has no findings; a very long text is
scanned whole; repeated rows each get their row; an empty table gives empty results; other columns are left out; a
blob with very many paths is joined in salted parts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which a blob's paths are joined: a blob that a third of all rows share
#: still spreads over that many tasks.
SALTS = 64


@dataclass(frozen=True)
class Rule:
    """Non-overlapping matches of pattern from the left; a match counts if the
    group `measured` has `least` characters."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(f'{self.pattern}|{self.measured}|{self.least}'.encode()).hexdigest()[:12]}"


#: The three kinds of the contract.  A run of hex digits or of the
#: access key's letters is a match as a whole or not at all, so its least length
#: can be part of the pattern; that of an assignment can't.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def _matches(text: Column, rule: Rule, k: int) -> Column:
    """An array of (rule, nth, gap before it, length, counts)."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.measured)), F.split(text, rule.pattern, -1))
    rows = F.transform(
        F.filter(parts, lambda p: p["0"].isNotNull()),
        lambda p, i: F.struct(F.lit(k).alias("rule"), i.alias("nth"), F.length(p["2"]).alias("gap"), F.length(p["0"]).alias("length"), (F.length(p["1"]) >= rule.least).alias("counts")),
    )
    return F.when(text.rlike(rule.pattern), rows).otherwise(F.array().cast("array<struct<rule:int,nth:int,gap:int,length:int,counts:boolean>>"))


def address(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, text): the content address of each version."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def unseen(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """(blob, text, todo): each distinct blob with the rule versions that the
    ledger (blob, rule_version) doesn't have for it; those with none are left out."""
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    every = F.array(*[F.lit(r.version) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    known = blobs.select("blob").join(seen, "blob", "left").select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    return blobs.join(known.where(F.size("todo") > 0), "blob")


def scan(todo: DataFrame, rules=RULES) -> DataFrame:
    """Findings (blob, rule_version, kind, start, end) of unseen blobs."""
    found = [F.when(F.array_contains("todo", r.version), _matches(F.col("text"), r, k)).otherwise(F.array().cast("array<struct<rule:int,nth:int,gap:int,length:int,counts:boolean>>")) for k, r in enumerate(rules)]
    rows = todo.select("blob", F.explode(F.concat(*found)).alias("m")).select("blob", "m.*")
    to_here = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = F.array(*[F.struct(F.lit(r.version).alias("version"), F.lit(r.kind).alias("kind")) for r in rules])
    end = F.sum(F.col("gap") + F.col("length")).over(to_here)
    return rows.select("blob", "rule", "length", "counts", end.alias("end")).where("counts").select("blob", F.element_at(names, F.col("rule") + 1).alias("of"), (F.col("end") - F.col("length")).alias("start"), "end").select("blob", F.col("of.version").alias("rule_version"), F.col("of.kind").alias("kind"), "start", "end")


@dataclass
class Scan:
    ledger: DataFrame  # (blob, rule_version), old and new
    findings: DataFrame  # (blob, rule_version, kind, start, end), old and new
    versions: DataFrame


def increment(docs: DataFrame, rules=RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None) -> Scan:
    """One step of the ledger.  Pass the tables of the step before, stored."""
    versions = address(docs)
    todo = unseen(versions, rules, ledger)
    new_findings = scan(todo, rules)
    new_pairs = todo.select("blob", F.explode("todo").alias("rule_version"))
    return Scan(new_pairs if ledger is None else ledger.unionByName(new_pairs), new_findings if findings is None else findings.unionByName(new_findings), versions)


def by_path(step: Scan, rules=RULES, base=BASE_RULES) -> DataFrame:
    """Findings joined back to all paths: a row a document, with counts of the
    base kinds, a digest of the base spans and all spans of current rules."""
    kinds = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.version, k)])
    current = step.findings.where(F.col("rule_version").isin([r.version for r in rules]))
    spans = current.select("blob", F.struct("start", kinds[F.col("rule_version")].alias("k"), "end", "kind").alias("s")).groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias("s"))

    def joined(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("s", lambda s: s.kind == kind))

    of_base = F.filter("s", lambda s: s.kind.isin([r.kind for r in base]))
    told = spans.select("blob", *[count(r.kind).cast("long").alias(f"n_{r.kind}") for r in base], F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = step.versions.select("doc_id", "blob").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = paths.join(told, ["blob", "salt"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in base], F.coalesce("base_sha256", F.lit(empty)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    return by_path(increment(docs, rules), rules)
