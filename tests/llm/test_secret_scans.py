import hashlib
import re

from boxrates.llm.queries import op3_secret_scans
from boxrates.llm.secret_scans import KINDS, find_secrets, scan_versions
from boxrates.session import work_dir

HEX = "0123456789abcdef" * 3
TEXTS = [
    None, "", "plain text", "password=hunter22", "PassWord : \"abc123==\"", "token=token:abcdef", "secret = 'x'",
    "api_key=abcdef apikey:ghijkl", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 20, HEX[:24], HEX[:23],
    "token = \"" + HEX[:40] + "\"", "paſſword=abcdef toKen=abcdef", "ä😀 password=abcdef AKIA" + "C" * 20,
    "ghp_" + "a1B2" * 9, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "-----BEGIN RSA PRIVATE KEY-----", "abc" * 50_000,
]


def base(text):
    """The base spans as the rules word them."""
    text = text or ""
    found = []
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    for kind, pattern, least, group in (
        ("assign", assign, 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0),
    ):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda f: (f[1], order.index(f[0])))


def versions(spark, rows):
    return spark.createDataFrame(
        [(i, f"p{i}", t, "old") for i, t in rows], "doc_id long, path string, text string, findings string"
    )


def spans(findings):
    return [(f["kind"], f["start"], f["end"]) for f in findings]


def test_base_spans_equal_the_rules():
    for text in TEXTS:
        found = spans(find_secrets(text or ""))
        assert [f for f in found if f[0] in ("assign", "access", "hex")] == base(text)
        assert found == sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def test_further_kinds():
    assert spans(find_secrets(TEXTS[16])) == [("github", 0, 40)]
    assert spans(find_secrets(TEXTS[17]))[0][0] == "jwt"
    assert spans(find_secrets(TEXTS[18])) == [("private_key", 0, len(TEXTS[18]))]


def test_every_path_gets_the_findings_of_its_blob(spark):
    rows = list(enumerate(TEXTS * 3))
    got = scan_versions(versions(spark, rows), work_dir(spark, "ledger"))
    assert got.columns == ["blob", "doc_id", "path", "findings"]
    assert {r.doc_id: spans(r.findings) for r in got.collect()} == {i: spans(find_secrets(t or "")) for i, t in rows}


def test_only_unseen_blobs_are_scanned(spark):
    ledger = work_dir(spark, "ledger")
    scan_versions(versions(spark, enumerate(TEXTS)), ledger)
    stored = spark.read.parquet(ledger).count()
    assert stored == len({t or "" for t in TEXTS})
    found = scan_versions(versions(spark, [(1, "password=abcdef"), (2, "plain text"), (3, "password=abcdef")]), ledger)
    assert {r.doc_id: len(r.findings) for r in found.collect()} == {1: 1, 2: 0, 3: 1}
    assert spark.read.parquet(ledger).count() == stored + 1


def test_empty_table(spark):
    assert scan_versions(versions(spark, []), work_dir(spark, "ledger")).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    versions(spark, enumerate(TEXTS)).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_secret_scans(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        found = base(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        assert got[i].base_sha256 == digest
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [
            sum(f[0] == kind for f in found) for kind in ("assign", "access", "hex")
        ]
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans(find_secrets(text or "")))
