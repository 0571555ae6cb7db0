"""Secret scans with an incremental ledger of blobs.

A blob is the SHA-256 of a text: equal texts under many paths, or in many versions of a path, are one blob. The ledger is a
table of (blob, rules, found): which versions of which rules have been run on a blob, and what they found. A scan takes only
the pairs of blob and rule version that the ledger lacks, each blob's text once, appends what it finds, and joins the findings
back to all paths. A second scan of the same texts reads no text beyond hashing it; a rule with a new version is run alone.

Defined cases: a null text is the empty blob; empty texts have no findings; repeated rows get the same findings; overlapping
findings of different kinds all stay; an empty table gives an empty result. Only path and text are read. Positions are code
points, ends exclusive. A ledger is appended to, so a failed scan may leave rows twice; readers fold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.session import scratch_dir


@dataclass(frozen=True)
class Rule:
    """pattern: matches are taken leftmost first, without overlap; those whose ``group`` has under ``least`` characters go.
    hints: a text without any of these (in lower case) can't match."""

    kind: str
    pattern: re.Pattern
    hints: tuple[str, ...] = ()
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = ("assign", "access", "hex")
#: In the order in which kinds are listed among findings that start together. A run of fewer than the least number of
#: characters holds no longer run, so the least length may stand in the patterns of access and hex, but not of assign.
RULES = (
    Rule("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("passw", "secret", "token", "api"), 2, 6),
    Rule("access", re.compile(r"AKIA[A-Z0-9]{16,}"), ("akia",)),
    Rule("hex", re.compile(r"[0-9a-f]{24,}")),
    Rule("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("private key-----",)),
    Rule("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"), ("eyj",)),
    Rule("hosting_token", re.compile(r"gh[opsru]_[A-Za-z0-9]{36,}"), ("gho_", "ghp_", "ghs_", "ghr_", "ghu_")),
    Rule("chat_token", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), ("xox",)),
)
LEDGER = "blob binary, rules array<string>, found array<struct<start:int,rank:int,end:int,rule:string,kind:string>>"


def findings(text: str, rules: list[tuple[int, Rule]]) -> list[dict]:
    """All matches of the rules in a text; rules come with their rank."""
    low, out = text.lower(), []
    for rank, rule in rules:
        if not rule.hints or any(h in low for h in rule.hints):
            for m in rule.pattern.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out.append({"start": m.start(), "rank": rank, "end": m.end(), "rule": rule.name, "kind": rule.kind})
    return out


def scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for (blob, text, rules): each text under the named rules."""
    ranked = {rule.name: (i, rule) for i, rule in enumerate(rules)}
    span = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("rule", pa.string()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows with equal id and text meet in one task, as they were dealt by both
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                blobs = batch.column("blob").to_pylist()
                fresh = [i for i, b in enumerate(blobs) if b not in seen and not seen.add(b)]
                batch = batch.take(pa.array(fresh, pa.int32()))
                found = [findings(t or "", [ranked[n] for n in names]) for t, names in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, pa.list_(span))], names=["blob", "rules", "found"])

    return texts.mapInArrow(run, LEDGER)


def scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger (a Parquet path, made if missing) up to date for the documents; then per document: id, blob, found."""
    spark, names = docs.sparkSession, F.array(*[F.lit(r.name) for r in rules])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blob = F.unhex(F.sha2(text.cast("binary"), 256))
    paths = docs.select(F.col(id_col).alias("id"), blob.alias("blob"))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger)
    done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_done"))  # as many as rules ever
    unseen = (
        paths.groupBy("blob").agg(F.min("id").alias("_id")).join(done, "blob", "left")
        .select(F.col("blob").alias("_blob"), "_id", F.array_except(names, F.coalesce("_done", F.array().cast("array<string>"))).alias("rules"))
        .where(F.size("rules") > 0)
    )
    # one path stands for its blob; only texts go through this join, once each, unsorted
    texts = docs.select(F.col(id_col).alias("id"), blob.alias("blob"), text.alias("text"))
    texts = texts.join(unseen.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("blob") == F.col("_blob")))
    scanned(texts.select("blob", "text", "rules"), rules).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).where(F.size("found") > 0)
    current = known.select("blob", F.explode("found").alias("f")).where(F.col("f.rule").isin(*[r.name for r in rules]))
    found = current.groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("found"))  # of one text
    return paths.join(found, "blob", "left").select(F.col("id").alias(id_col), F.lower(F.hex("blob")).alias("blob"), F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def secret_report(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts by base kind, digest of the base spans, and all spans as text."""
    out = scan(docs, ledger or scratch_dir(docs.sparkSession, "secret-ledger"), id_col, text_col)
    as_text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return out.select(id_col, *[count(k) for k in BASE], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))
