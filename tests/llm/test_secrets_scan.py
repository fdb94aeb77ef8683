import hashlib
import re
import time

from pyspark.sql import functions as F

from ledgerloom.llm.secrets_scan import WIDE_OWNERS, redacted, scan_secrets

KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
TOKEN = "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9v"


def brute(text):
    found = []
    for k, (name, (pattern, group, least)) in enumerate(KINDS.items()):
        found += [(m.start(), k, m.end(), name) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


ROWS = [
    (1, "é password=abcdefghijkl and token: 'ABCDEF0123456789' 0123456789abcdef", "a"),
    (1, "é password=abcdefghijkl and token: 'ABCDEF0123456789' 0123456789abcdef", "a"),
    (2, "token: secret: abcdefghijklmnop", "a"),
    (3, "password=secret=abcdefghijklmnop api_key = \"zzzzzzzzzzzz\"", "b"),
    (4, "AKIAAKIAAKIAAKIA12 AKIA123 AKIA" + "Z" * 40, None),
    (5, None, "c"),
    (6, "", "c"),
    (None, "\U0001f600 APIKEY:'0123456789abcdef0123'", "c"),
    (7, "plain " * 30_000 + "passwd=0123456789ab", "d"),
    (8, f"see {TOKEN} here", "e"),
    *((100 + i, "docs say secret=examplevalue0 and " + "Zz9" * 10, f"s{i}") for i in range(WIDE_OWNERS)),
]


def test_same_as_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("spans", F.lit(1))
    out = scan_secrets(docs, keep=["doc_id", "text", "spans"]).collect()
    assert len(out) == len(ROWS)
    for r in out:
        want = brute(r["text"] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in want) for k in range(3)]
        joined = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("token")] == [s for s in joined.split(",") if s]
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[8]["spans"] == f"token:4:{4 + len(TOKEN)}" and by_id[8]["found"][0]["live"]
    shared = by_id[100]
    assert [s["kind"] for s in shared["found"]] == ["assign"] and not shared["found"][0]["live"]
    assert scan_secrets(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["clean"] for r in scan_secrets(docs, keep=["doc_id", "text"]).withColumn("clean", redacted(F.col("text"), F.col("found"))).collect()}
    assert out[1] == "é [secret] and [secret]' [secret]"
    assert out[3] == "[secret] [secret]\""
    assert out[8] == "see [secret] here"
    assert out[100] == ROWS[-WIDE_OWNERS][1] and out[5] is None and out[6] == ""
    assert out[7] == "plain " * 30_000 + "[secret]"


def test_many_matches_in_one_text(spark):
    """A list of 200,000 checksums: places are found in time that grows with the matches."""
    lines = [f"{i * 2654435761 % 2**64:016x}  file{i % 1000}" for i in range(200_000)]
    text = "\n".join(lines)
    began = time.time()
    row = scan_secrets(spark.createDataFrame([(1, text, "a"), (2, "deadbeefdeadbeef", "b")], "doc_id long, text string, source string")).where("doc_id = 1").select("n_hex", "base_sha256").first()
    assert time.time() - began < 60
    want = ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{16,}", text))
    assert row["n_hex"] == 200_000 and row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
