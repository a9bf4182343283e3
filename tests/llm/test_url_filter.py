import re

import pytest

from basketlens.llm import url_filter as u

URLS = [
    None, "", "no scheme", "http://", "https://Example.NET/en/1", "https://a.example.net/EN/1", "http://net/", "http://net",
    "http://x.net?q=/en/", "http://sub.example.com/de/x#y", "http://example.com.de/de/", "https://org/fr/", "https://a.org/fr", "http://notexample.net:80/en/",
    "a://b://c/d", "http://ÄB.Net/x", "http://h/p?q#f", "http://h#f/p", "http://casino-bets.example.com/en/1", "https://m.garden.example.org/en/77",
]


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    hits = [(len(h + p), h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(hits)[1:] if hits else (None, None))


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, x, "clash") for i, x in enumerate(URLS)]
    return {r["page_id"]: r for r in u.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), u.labelled(spark)).collect()}


def test_parts_and_rules(judged):
    for i, url in enumerate(URLS):
        host, path, rule, verdict = slow(url)
        r = judged[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_features_are_the_runs_of_characters(spark):
    """As many buckets as distinct runs of three, four and five, each that of its text."""
    rows = [(x,) for x in URLS if x and len(x) < 60]
    df = spark.createDataFrame(rows, "url string")
    got = {r["url"]: r["f"] for r in df.select("url", u.features(u.host_of(df["url"]), u.path_of(df["url"])).alias("f")).collect()}
    grams = {}
    for (url,) in rows:
        host, path, *_ = slow(url)
        text = re.sub("[1-9]", "0", f"^{host}${path.lower() if path.isascii() else path}")
        grams[url] = {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)} if host + path else set()
    every = spark.createDataFrame([(g,) for g in set().union(*grams.values())], "g string")
    bucket = {r["g"]: r["b"] for r in every.selectExpr("g", f"pmod(xxhash64(g), {u.BUCKETS}) AS b").collect()}
    for (url,) in rows:
        assert len(got[url]) == len(set(got[url])) and set(got[url]) == {bucket[g] for g in grams[url]}, url


def test_held_out_accuracy(spark):
    """Trained on two thirds of the names, judged on the rest."""
    rows = u.labelled(spark).collect()
    third = {name for names in (u.TO_BLOCK, u.TO_ALLOW) for name in names[::3]}
    out = [not third.isdisjoint(re.split(r"[/.]", r["url"])) for r in rows]
    train = spark.createDataFrame([r for r, o in zip(rows, out, strict=True) if not o], "url string, label int")
    test = spark.createDataFrame([r for r, o in zip(rows, out, strict=True) if o], "url string, label int")
    got = u.judge(test, train, rules=()).collect()
    assert len(got) == 160
    assert sum((r["verdict"] == "block") == (r["label"] == 1) for r in got) >= 0.85 * len(got)


def test_training_is_gradient_descent(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(u, "STEPS", 5)
    labels = spark.createDataFrame([("http://aaaa/b", 1), ("http://cccc/d", 0), ("http://aacc/e", 1), (None, 0), ("x", None)], "url string, label int")
    rows = labels.where("label is not null").select("label", u.features(u.host_of(labels["url"]), u.path_of(labels["url"])).alias("f")).collect()
    w, b = np.zeros(u.BUCKETS), 0.0
    for _ in range(5):
        gw, gb = np.zeros(u.BUCKETS), 0.0
        for r in rows:
            scale = 1 / np.sqrt(len(r["f"])) if r["f"] else 0.0
            e = 1 / (1 + np.exp(-(w[r["f"]].sum() * scale + b))) - r["label"]
            np.add.at(gw, r["f"], e * scale / len(rows))
            gb += e / len(rows)
        w, b = w * (1 - u.RATE * u.DECAY) - u.RATE * gw, b * (1 - u.RATE * u.DECAY) - u.RATE * gb
    got = {r["bucket"]: r["weight"] for r in u.train(labels).collect()}
    assert abs(got.pop(-1) - b) < 1e-9
    assert all(abs(w[k] - v) < 1e-9 for k, v in got.items()) and len(got) == (w != 0).sum()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(none, u.labelled(spark)).count() == 0
    one = u.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), u.labelled(spark).limit(0)).first()
    assert one["verdict"] == "allow"


def test_own_rules_replace_the_given_ones(spark):
    df = spark.createDataFrame([("http://a.org/fr/1",), ("http://b.a.org/x",)], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in u.judge(df, u.labelled(spark).limit(0), rules=(("a.org", "/x", "block"),)).collect()}
    assert got == {"http://a.org/fr/1": (None, "allow"), "http://b.a.org/x": ("a.org/x", "block")}
