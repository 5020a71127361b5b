"""Findings of identity, secret, path and size leaks in texts and file trees."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What is looked for.
MOST_BYTES = 95 * 1024 * 1024
IGNORED_PARTS = [".git", "__pycache__", ".test-tmp"]
NEUTRAL_EMAILS = ["anonymous@invalid.example"]
NEUTRAL_IDENTITY = "Anonymous Authors <anonymous@invalid.example>"
LOCAL_PATH = r"/(?:Users|home)/|[A-Za-z]:\\Users\\"
PRIVATE_NETWORK = r"(?<!\d)(?:10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})(?!\d)"
CREDENTIAL = r"""(?i)\b(?:api[_-]?key|access[_-]?token|secret|password)\s*[:=]\s*["']?[A-Za-z0-9][A-Za-z0-9._-]{3,}"""
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"


def emails(text: Column) -> Column:
    """The distinct lower-case addresses of a text without the neutral ones, sorted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower)
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, NEUTRAL_EMAILS))))


def findings(df: DataFrame, label: str, text: str, size: str | None = None, owner: str | None = None, most: int = MOST_BYTES) -> DataFrame:
    """(label, reason), distinct: every finding of every row in one pass.

    A null text has no content findings; size is a column of bytes; owner a marker that must occur
    neither in labels nor in texts, in any case.
    """
    name, body = F.col(label).cast("string"), F.col(text)
    tests = [
        F.when(body.rlike(LOCAL_PATH), F.lit("local path")),
        F.when(body.rlike(PRIVATE_NETWORK), F.lit("private network address")),
        F.when(body.rlike(CREDENTIAL), F.lit("credential-like assignment")),
    ]
    if size is not None:
        tests.append(F.when(F.col(size) >= most, F.format_string("oversized file (%d bytes)", F.col(size))))
    if owner is not None:
        tests.append(F.when(F.contains(F.lower(name), F.lit(owner.lower())), F.lit("repository owner appears in filename")))
        tests.append(F.when(F.contains(F.lower(body), F.lit(owner.lower())), F.lit("repository owner identity")))
    addresses = F.transform(F.coalesce(emails(body), F.array().cast("array<string>")), lambda e: F.concat(F.lit("email address "), e))
    return df.select(name.alias("label"), F.explode(F.concat(F.array_compact(F.array(*tests)), addresses)).alias("reason")).distinct()


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(label, bytes, content) of the files under a folder; content is null where it isn't UTF-8."""
    from urllib.parse import unquote

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + unquote(root.split(":", 1)[-1]).strip("/") + "/"
    label = F.substring_index(F.col("path"), base, -1)
    ignored = F.exists(F.split(label, "/"), lambda p: p.isin(IGNORED_PARTS))
    return files.filter(~ignored).select(label.alias("label"), F.col("length").alias("bytes"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"))


def tree_findings(spark: SparkSession, root: str, owner: str | None = None, most: int = MOST_BYTES, include_git: bool = False) -> DataFrame:
    """(label, reason) of a folder, sorted."""
    out = findings(file_tree(spark, root), "label", "content", "bytes", owner, most)
    if include_git:
        out = out.unionByName(git_identities(spark, root))
    return out.distinct().orderBy("label", "reason")


def git_identities(spark: SparkSession, root: str, allowed: str = NEUTRAL_IDENTITY) -> DataFrame:
    """(label, reason) of commit identities other than the neutral one; one finding if there is no history."""
    run = subprocess.run(["git", "log", "--format=%an <%ae>%n%cn <%ce>"], cwd=root, check=False, capture_output=True, text=True)
    if run.returncode:
        rows = [("git", "unable to inspect commit identity")]
    else:
        rows = [("git", f"non-neutral identity: {x}") for x in sorted({x.strip() for x in run.stdout.splitlines() if x.strip()}) if x != allowed]
    return spark.createDataFrame(rows, "label string, reason string")
