import hashlib
import re

import pytest
from pyspark.sql import functions as F

from basketlens.llm import secret_scan as s

KEY = "AKIA" + "Q7" * 8


def spans(spark, texts, **more):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts string")
    found = s.scan_secrets(docs, keep_text=False, **more).select("doc_id", s.joined(F.col("secret_spans")).alias("j"))
    return {r["doc_id"]: r["j"] for r in found.collect()}


def slow_base(text):
    """Base spans by plain scans over every position."""
    out = []
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    at = 0
    while m := assign.search(text, at):
        at = m.end()
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for rank, (kind, head, more, least) in enumerate((("access", "AKIA", "[A-Z0-9]", 16), ("hex", "", "[0-9a-f]", 32)), 1):
        for m in re.finditer(head + more + "+", text):
            if len(m[0]) >= least:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_are_those_of_plain_scans(spark):
    texts = [
        None, "", "   ", "password=short", "PassWord = 'longenough1'", "token=secret:abcdefghijk", f"x {KEY}z AKIAABC",
        "é" * 50 + " api_key: " + "0a" * 20, "\u017fecret=abcdefgh1", "secret=abcdefgh" * 3, "f" * 31 + " " + "f" * 32,
    ]
    got = spans(spark, texts)
    assert [got[i] for i in range(len(texts))] == [slow_base(t or "") for t in texts]


def test_weak_parts_count_only_together(spark):
    texts = [
        "user=alice and nothing else",
        "pwd=hunter2 alone",
        "user=alice pwd=hunter2",
        "user=alice\n\npwd=hunter2",  # two paragraphs
        "host=db.internal user=alice pwd=hunter2",
        "host=db.internal user=alice",
        f"{KEY} pwd=hunter2",
    ]
    got = spans(spark, texts)
    assert [got[i] for i in (0, 1, 3, 5)] == [""] * 4
    assert got[2] == "identifier:0:10,weak_secret:11:22"
    assert got[4] == "endpoint:0:16,identifier:17:27,weak_secret:28:39"
    assert got[6] == f"access:0:{len(KEY)},weak_secret:{len(KEY) + 1}:{len(KEY) + 12}"


@pytest.mark.parametrize("width", [1, 7, 100, 4096])
def test_interval_join_agrees_with_all_pairs_in_a_long_text(spark, width):
    text = " ".join(f"user=u{i}" + " y" * (i % 37) + (f" pwd=secret{i}" if i % 3 else "") + ("\n\n" if i % 11 == 0 else "") for i in range(400))
    parts = s.find_parts(text)
    want = []
    for kind, start, end, low, high in parts:
        roles = {s.ROLE[k] for k, a, b, *_ in parts if low <= a and b <= high and s.ROLE[k] != s.ROLE[kind]}
        if kind not in s.KINDS and {"secret": "id" in roles, "id": "secret" in roles, "endpoint": {"id", "secret"} <= roles}[s.ROLE[kind]]:
            want.append((kind, start, end))
    rows = spark.createDataFrame([(1, [dict(zip(("kind", "start", "end", "scope_start", "scope_end"), p)) for p in parts])], f"_key long, parts array<{s.PART}>")
    linked = s.link_parts(rows, "_key", width)
    assert sorted(tuple(r)[1:] for r in linked.collect()) == sorted(want) and len(want) > 300
    if width == s.BUCKET:
        both = sorted([*want, *s.base_spans(text)], key=lambda p: (p[1], s.ORDER.index(p[0])))
        assert spans(spark, [text])[0] == ",".join(f"{k}:{a}:{b}" for k, a, b in both)
        plan = re.sub(r"#\d+L?", "", linked._jdf.queryExecution().optimizedPlan().toString())
        assert len(re.findall(r"Join Inner, .*start >= scope_start.*end <= scope_end", plan)) == 2


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "user=a1 pwd=hunter2"), (1, "user=a1 pwd=hunter2"), (1, "plain"), (None, "user=a1 pwd=hunter2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.scan_secrets(docs).select("doc_id", F.size("secret_spans").alias("n")).collect()
    assert sorted((r["doc_id"] or 0, r["n"]) for r in got) == [(0, 2), (1, 0), (1, 2), (1, 2)]
    assert s.scan_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a password=longenough1 b", f"{KEY}{KEY} end", "no secret", "é token=" + "ab" * 20 + " ü"])
def test_redaction_leaves_the_rest(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = s.scan_secrets(docs).select(s.redact(F.col("text"), F.col("secret_spans")).alias("t")).first()["t"]
    want, at = "", 0
    for _, start, end in sorted(s.base_spans(text), key=lambda x: x[1]):
        if start >= at:
            want += text[at:start] + "[SECRET]"
        at = max(at, end)
    assert got == want + text[at:]


def test_query_digest(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


@pytest.mark.parametrize(
    "identifier, secret",
    [
        ("user: bob", "password: hunt3r"),
        ("user=bob", "password=P@ssw0rd!2024"),
        ("DB_USER=bob", "DB_PASS=abcd!efg"),
        ("aws.account = me", "aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
        ('"dbUser": "bob"', '"apiKey": "a b,c d"'),
        ("login=bob", "token=ab" + "!x" * 300),
    ],
)
def test_pairs_of_common_names(spark, identifier, secret):
    shut = len(secret) - secret.endswith('"')
    got = spans(spark, [f"{identifier}\n{secret}", identifier, secret])
    at = len(identifier) + 1
    end = len(identifier) - identifier.endswith('"')
    low = int(identifier.startswith('"'))
    assert got[0] == f"identifier:{low}:{end},weak_secret:{at + int(secret.startswith(chr(34)))}:{at + shut}"
    assert got[1] == got[2] == ""


def test_access_id_with_its_secret_key_and_cut_base_values(spark):
    key = "aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    got = spans(spark, [f"{KEY} {key}", key, "user=bob password=longenough1!rest", "password=longenough1!rest", "user=bob password=longenough1)."])
    assert got[0] == f"access:0:{len(KEY)},weak_secret:{len(KEY) + 1}:{len(KEY) + 1 + len(key)}" and got[1] == ""
    assert got[2] == "identifier:0:8,assign:9:29,weak_secret:9:34"
    assert got[3] == "assign:0:20" and got[4] == "identifier:0:8,assign:9:29"


def test_a_paragraph_links_however_long(spark, tmp_path):
    far = "user=alice" + " x" * 4000 + " pwd=hunter2"
    texts = [far, "host=db.internal" + " x" * 4000 + "\n" + far, far.replace(" pwd", "\n\npwd")]
    got = spans(spark, texts)
    n = len(far)
    assert got[0] == f"identifier:0:10,weak_secret:{n - 11}:{n}" and got[2] == ""
    assert [x.split(":")[0] for x in got[1].split(",")] == ["endpoint", "identifier", "weak_secret"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked = {r["doc_id"]: r["spans"] for r in s.op1_secrets(spark, str(tmp_path)).collect()}
    assert asked == got


def test_long_values_are_whole(spark):
    name, host = "n" * 900, "h." * 400 + "internal"
    text = f"host={host} user={name} pwd=hunter2"
    assert spans(spark, [text])[0] == f"endpoint:0:{5 + len(host)},identifier:{6 + len(host)}:{11 + len(host) + 900},weak_secret:{len(text) - 11}:{len(text)}"
