"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Each version of a text is a blob named by its SHA-256.  The ledger holds which
(blob, rule version) pairs have been scanned, the findings table what they
held.  A scan reads only blobs whose pair the ledger lacks, and findings join
back to every path (document) that carries the blob.

Positions are code points, end exclusive.  For a rule, the gaps
(``split``) and the matches (``regexp_extract_all``) of one pattern alternate,
so a running sum of lengths gives the spans without a per-row function.

Defined results: a null text is the empty blob; equal texts share one scan; an
empty table gives no findings; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.llm import common as C


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0      # the group whose length is held against least
    least: int = 1


#: Base kinds in listed order, then the method's own.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),      # a run of 24 or more is a maximal run that passes
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
RULES = BASE + MORE
RULE_VERSION = "1"

LEDGER = "blob string, rule_version string"
FINDINGS = "blob string, rule_version string, n array<long>, base string, spans string"


def blob_of(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _spans(text, rule: Rule, order: int) -> F.Column:
    """Array of (start, order, end) for a rule's matches that pass."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    held = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m)) if rule.group else F.transform(whole, lambda m: F.length(m))
    sizes = F.transform(whole, lambda m: F.length(m))
    steps = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), held.alias("held"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["held"] >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("kind"), (acc["at"] + x["gap"] + x["size"]).alias("end"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    # split and extract run only where the pattern occurs
    return F.when(F.rlike(text, F.lit(rule.pattern)), walk).otherwise(none)


def _joined(spans, rules) -> F.Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def scan(blobs: DataFrame, rules=RULES, n_base: int = len(BASE)) -> DataFrame:
    """``(blob, n, base, spans)`` of rows ``(blob, text)``; ``n`` counts by rule.
    Blobs without a finding give no row."""
    df = blobs.select("blob", *[_spans(F.col("text"), r, i).alias(f"r{i}") for i, r in enumerate(rules)])
    every = [F.col(f"r{i}") for i in range(len(rules))]
    df = df.filter(" or ".join(f"size(r{i}) > 0" for i in range(len(rules))))
    return df.select("blob", F.array(*[F.size(c).cast("long") for c in every]).alias("n"),
                     _joined(F.concat(*every[:n_base]), rules).alias("base"), _joined(F.concat(*every), rules).alias("spans"))


class Ledger:
    """Two append-only Parquet tables below ``path``: the pairs scanned and the
    findings.  A pair is entered after its findings, and findings are read as a
    set, so a scan that breaks off is repeated without harm."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("scanned", LEDGER), ("findings", FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(LEDGER if name == "scanned" else FINDINGS).parquet(f"{self.path}/{name}")

    def update(self, docs: DataFrame, text_col="text", rules=RULES, version: str = RULE_VERSION) -> None:
        """Scan the blobs of ``docs`` whose (blob, version) pair is new."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        versions = docs.select(blob_of(F.col(text_col)).alias("blob"), text.alias("text"))
        seen = self.table("scanned").filter(F.col("rule_version") == version).select("blob")
        fresh = versions.join(seen, "blob", "left_anti") if seen.head(1) else versions
        fresh = fresh.groupBy("blob").agg(F.first("text").alias("text"))      # equal blobs, equal texts
        scan(fresh, rules).select("blob", F.lit(version).alias("rule_version"), "n", "base", "spans").write.mode("append").parquet(f"{self.path}/findings")
        new = docs.select(blob_of(F.col(text_col)).alias("blob")).distinct()
        new = new.join(seen, "blob", "left_anti") if seen.head(1) else new
        new.select("blob", F.lit(version).alias("rule_version")).write.mode("append").parquet(f"{self.path}/scanned")

    def findings(self, version: str = RULE_VERSION) -> DataFrame:
        return self.table("findings").filter(F.col("rule_version") == version).drop("rule_version").distinct()

    def of_paths(self, docs: DataFrame, id_col="doc_id", text_col="text", version: str = RULE_VERSION) -> DataFrame:
        """One row per document: ``id, blob, n, base, spans`` (null without a finding)."""
        paths = docs.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob"))
        return paths.join(self.findings(version), "blob", "left")
