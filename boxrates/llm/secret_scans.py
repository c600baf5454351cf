"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the digest of its content. A blob is scanned
once per version of the rules, whatever number of paths and revisions carry it; findings
are joined back to all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxrates.llm.common import digest_of, text_of
from boxrates.llm.ledger import extend

FINDING = T.ArrayType(
    T.StructType().add("kind", "string").add("start", "long").add("end", "long"), False
)

# The base kinds in their order, pattern and least length. A match of the
# first is judged by its second group, of the others by its whole length.
BASE = [
    (
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
]

# Further kinds, pattern and a string that every match holds.
MORE = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    ("google", r"AIza[0-9A-Za-z_-]{35}", "AIza"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    ("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", "PRIVATE KEY"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
]

KINDS = [kind for kind, *_ in BASE] + [kind for kind, *_ in MORE]

RULES_VERSION = hashlib.sha256(repr((BASE, MORE)).encode()).hexdigest()[:16]

_ASSIGN = re.compile(BASE[0][1], re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(BASE[1][1])
# Runs are maximal either way, so asking for the length here finds the same ones sooner.
_HEX = re.compile(r"[0-9a-f]{%d,}" % BASE[2][2])
_MORE = [(kind, re.compile(pattern), mark) for kind, pattern, mark in MORE]


def find_secrets(text: str) -> list[dict]:
    """Spans of one text by start, then kind in the order of ``KINDS``."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _ASSIGN_WORDS):
        found += [
            ("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= BASE[0][2]
        ]
    if "AKIA" in text:
        found += [
            ("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= BASE[1][2]
        ]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, pattern, mark in _MORE:
        if mark in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    found.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    return [{"kind": kind, "start": start, "end": end} for kind, start, end in found]


@F.pandas_udf(FINDING)
def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([find_secrets(t) for t in batch], dtype="object")


def scan_versions(versions: DataFrame, ledger: str) -> DataFrame:
    """All columns of ``versions`` except the text, with ``blob`` and ``findings``.

    ``versions`` has a column ``text``, one row per path and revision; further columns
    (path, revision, ids) are kept, those named ``blob`` or ``findings`` are replaced.
    ``ledger`` is a folder that all machines share and that later runs extend: what it holds
    of this version of the rules is not scanned again.

    - NULL text is the empty blob, which has no findings.
    - Rows may repeat; each gets the findings of its blob. An empty table stays empty.
    """
    plain = versions.drop("blob", "findings")
    blobs = plain.select(text_of().alias("text")).withColumn("digest", digest_of(F.col("text")))
    known = extend(blobs, ledger, RULES_VERSION, _scan, FINDING)
    rows = plain.withColumn("blob", digest_of(text_of())).drop("text")
    return rows.join(
        known.select(F.col("digest").alias("blob"), F.col("result").alias("findings")), "blob"
    )


def joined_spans(findings: Column) -> Column:
    """Findings as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ","
    )


def base_only(findings: Column) -> Column:
    kinds = [kind for kind, *_ in BASE]
    return F.filter(findings, lambda f: f["kind"].isin(kinds))


def count_kind(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("bigint")
