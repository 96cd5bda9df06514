"""Detection-rule corpus: parsing and search text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: rule classes and their descriptions
CLASS_DESCRIPTIONS = {
    "trojan-activity": "A network trojan was detected — malware C2 or dropper activity",
    "attempted-admin": "Attempted administrator privilege gain — exploitation of admin services",
    "attempted-user": "Attempted user privilege gain — local or remote privilege escalation",
    "shellcode-detect": "Executable code was detected — shellcode injection or memory exploit",
    "successful-admin": "Successful administrator privilege gain",
    "successful-user": "Successful user privilege gain",
    "unsuccessful-user": "Unsuccessful user privilege gain attempt",
    "policy-violation": "Potential corporate privacy violation or policy breach",
    "network-scan": "Detection of a network scan — port scanning or host discovery",
    "denial-of-service": "Detection of a denial of service attack",
    "attempted-dos": "Attempted denial of service attack",
    "successful-dos": "Successful denial of service attack",
    "protocol-command-decode": "A suspicious protocol command was decoded",
    "web-application-attack": "Web application attack — SQL injection, XSS, or RCE attempt",
    "exploit-kit": "Exploit kit activity detected",
    "inappropriate-content": "Inappropriate content was detected",
    "misc-attack": "Miscellaneous attack detected",
    "misc-activity": "Miscellaneous activity detected",
    "bad-unknown": "Unknown traffic with bad characteristics",
    "not-suspicious": "Not a suspicious traffic pattern",
    "unknown": "Unknown traffic classification",
    "potential-vulnerability": "Traffic that could exploit a known vulnerability",
    "credential-theft": "Credential theft or credential harvesting activity",
    "targeted-activity": "Targeted malicious activity",
    "command-and-control": "Command and control (C2) communication detected",
}

# fixed values: where each option sits in a rule line
SID = r"\bsid:\s*(\d+)\s*;"
MSG = r'\bmsg:\s*"([^"]+)"\s*;'
# (the two below leave white space to the trimming further down, which gives the same values)
CLASSTYPE = r"\bclasstype:([^;]+);"
METADATA = r"\bmetadata:([^;]+);"


def class_description(classtype: Column) -> Column:
    """Description of a rule class; an unlisted class describes itself."""
    table = F.create_map(*[F.lit(x) for pair in CLASS_DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, classtype), classtype)


def _option(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parsed_rules(lines: DataFrame, metadata_length: int | None = None) -> DataFrame:
    """Rule lines (`value`, plus any ordering columns) to sid, msg, classtype and search text.

    `metadata_length` cuts the metadata part of the search text; by default all of it is kept.

    Blank and commented lines and lines without sid or msg are skipped.
    """
    kept = [c for c in lines.columns if c != "value"]
    options = F.struct(
        _option(SID).try_cast("bigint").alias("sid"), _option(MSG).alias("msg"),
        F.coalesce(_stripped(_option(CLASSTYPE)), F.lit("")).alias("classtype"), _option(METADATA).alias("metadata"),
    )
    # a filter is not pushed below the generator, so every option is looked for once a line
    return (
        lines.filter(~F.col("value").rlike(r"^\s*(#|$)"))
        .select(*kept, F.inline(F.array(options)))
        .filter("sid IS NOT NULL AND msg IS NOT NULL")
        .select(*kept, "sid", "msg", "classtype",
                search_text(F.col("msg"), F.col("classtype"), F.col("metadata"), metadata_length).alias("chunk_text"))
    )


def search_text(msg: Column, classtype: Column, metadata: Column, metadata_length: int | None = None) -> Column:
    """Sentence a rule is searched by; the category and metadata parts are left out when empty."""
    category = F.when(classtype != "", F.concat(F.lit("Category: "), class_description(classtype)))
    tidy = F.nullif(F.trim(F.regexp_replace(metadata, r"(?U)\s+", " ")), F.lit(""))
    details = F.concat(F.lit("Metadata: "), tidy if metadata_length is None else F.substring(tidy, 1, metadata_length))
    parts = F.concat_ws(". ", F.concat(F.lit("Suricata rule: "), msg), category, details)
    return F.concat(parts, F.lit("."))


def latest_rules(rules: DataFrame, order: str = "position") -> DataFrame:
    """One rule per sid: the last one in the file."""
    last = F.max(F.struct(order, "msg", "classtype", "chunk_text")).alias("r")
    return rules.groupBy("sid").agg(last).select("sid", "r.msg", "r.classtype", "r.chunk_text")


def stale_index(lines: DataFrame, meta: DataFrame) -> DataFrame:
    """The index watermark and the source's modification time, with `stale` when they differ."""
    stored = meta.filter(F.col("key") == "rules_mtime").agg(F.max("value").alias("indexed_mtime"))
    current = lines.agg(F.max("modified_at").cast("string").alias("rules_mtime"))
    both = current.unionByName(stored, allowMissingColumns=True).agg(
        F.max("rules_mtime").alias("rules_mtime"), F.max("indexed_mtime").alias("indexed_mtime")
    )
    return both.withColumn("stale", ~F.col("rules_mtime").eqNullSafe(F.col("indexed_mtime")))


def index_meta(rules: DataFrame, mtime: str) -> DataFrame:
    """Metadata rows to store after a rebuild."""
    return rules.agg(F.count("*").cast("string").alias("n")).select(
        F.explode(F.create_map(F.lit("rules_mtime"), F.lit(mtime), F.lit("rule_count"), "n")).alias("key", "value")
    )
