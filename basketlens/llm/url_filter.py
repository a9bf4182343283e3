"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for the rest.

Everything is a DataFrame expression. Training looks only at a labelled table of bounded size
(``MAX_LABELS`` rows, an error beyond), so it fits one row: full-batch gradient descent in the
dual form needs the inner products of the labelled rows and one coefficient for each of them.
The weights are sums of these coefficients per bucket, at most ``BUCKETS`` numbers; they enter
the plan of the scoring as one literal, and no page is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm.tables import ascii_lower, table

BUCKETS = 8192
GRAMS = (3, 4, 5)
STEPS = 120
RATE = 8.0
DECAY = 0.0003
MAX_LABELS = 500

# Rules as (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

# Host names of the labelled table, four of a kind. Both lists are as long and come in the same shapes, so the
# shape itself (subdomain, domain, language, number) tells nothing.
TO_BLOCK = (
    "adult-videos", "adult-chat", "adult-dating", "adult-photos", "porn-tube", "porn-videos", "free-porn", "porn-stars",
    "xxx-cams", "xxx-movies", "live-xxx", "xxx-photos", "sex-shop", "sex-chat", "sexcams", "live-sex",
    "escort-girls", "city-escorts", "escort-service", "vip-escort", "casino-royal", "casino-bonus", "online-casino", "casino-slots",
    "poker-win", "poker-room", "online-poker", "pokerbonus", "win-jackpot", "jackpot-slots", "free-slots", "mega-jackpot",
    "free-bets", "sports-bets", "betting-tips", "live-betting", "cheap-pills", "pills-online", "diet-pills", "buy-pills",
    "cheap-viagra", "viagra-online", "cheap-meds", "meds-online", "spam-links", "link-farm", "spam-farm", "buy-links",
    "ads-server", "ads-track", "click-track", "popup-ads", "free-warez", "crack-keygen", "torrent-free", "warez-crack",
    "payday-loans", "fast-loans", "loans-online", "free-phone-win",
)
TO_ALLOW = (
    "thenews", "local-news", "newspaper", "daily-news", "weather", "the-weather", "weather-map", "weather-station",
    "library", "public-library", "librarian", "bookshop", "school", "high-school", "schoolbooks", "education",
    "university", "universities", "college", "uni-press", "research", "researchers", "research-lab", "science",
    "travel", "traveller", "train-travel", "tourist-information", "music", "musician", "music-school", "orchestra",
    "theatre", "theatres", "museum", "the-stage", "gardening", "gardeners", "garden-plants", "the-garden",
    "cooking", "home-cooking", "cookbook", "recipes", "history", "local-history", "historian", "national-history",
    "mountains", "mountain-guide", "northern-mountains", "hiking", "house", "bathroom", "housing", "brothers",
    "encyclopedia", "thinking", "gathering", "earth",
)
SHAPES = (
    "https://{}.example.com/en/3017", "http://blog.{}.example.com/fr/28.html",
    "https://m.{}.com/de/511/", "https://www.{}.example.com/es/40211?page=2",
    "http://{}.example.org/de/95.html", "https://blog.{}.co.uk/en/7044#top",
    "http://m.{}.example.org/fr/20418", "http://www.{}.info/en/613/",
)
SHAPES_EACH = 4  # names take the first and the second half of the shapes in turn


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    own = (host == rule_host) | host.endswith("." + rule_host)
    return own & path.startswith(rule_path)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in reversed(ordered):
        hit = fits(host, path, rule_host, rule_path)
        name = F.when(hit, rule_host + rule_path).otherwise(name)
        verdict = F.when(hit, says).otherwise(verdict)
    return name, verdict


def features(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the character n-grams of host and path; empty for an empty URL.

    All digits count as 0: numbers of pages say nothing about them.
    """
    text = F.translate(F.concat(F.lit("^"), host, F.lit("$"), ascii_lower(path)), "123456789", "000000000")
    text = F.when((host == "") & (path == ""), "").otherwise(text)
    return F.array_distinct(F.concat(*[_grams(text, n) for n in GRAMS]))


def _grams(text: Column, n: int) -> Column:
    """Buckets of all runs of ``n`` characters."""

    def bucket(at: Column) -> Column:  # one parameter: a second would be the place in the array
        return F.pmod(F.xxhash64(F.substring(text, at, F.lit(n))), F.lit(BUCKETS)).cast("int")

    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(starts, bucket)).otherwise(F.array().cast("array<int>"))


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table (url, label); 1 is to block."""
    rows = [
        (shape.format(name), label)
        for label, names in ((1, TO_BLOCK), (0, TO_ALLOW))
        for i, name in enumerate(names)
        for shape in (SHAPES[:SHAPES_EACH], SHAPES[SHAPES_EACH:])[i % 2]
    ]
    return spark.createDataFrame(rows, "url string, label int")


def train(labels: DataFrame) -> DataFrame:
    """Weights (bucket, weight); bucket -1 is the intercept. Labels other than 0 and 1 are left out.

    Rows are unit vectors. The coefficients start at 0, and every step is one of gradient
    descent on the mean log loss with weight decay.
    """
    rows = labels.where(F.col("label").isin(0, 1)).select(
        F.coalesce("url", F.lit("")).alias("url"), F.col("label").cast("double").alias("y")
    )
    rows = rows.limit(MAX_LABELS + 1).select("url", "y", features(host_of(F.col("url")), path_of(F.col("url"))).alias("f"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("url", "y", "f"))).alias("ex"))
    one = one.select(F.when(F.size("ex") <= MAX_LABELS, F.col("ex")).otherwise(F.raise_error(f"more than {MAX_LABELS} labels")).alias("ex"))

    def likeness(a: Column, b: Column) -> Column:
        norm = F.sqrt(F.size(a["f"]).cast("double")) * F.sqrt(F.size(b["f"]).cast("double"))
        return F.when(norm > 0, F.size(F.array_intersect(a["f"], b["f"])) / norm).otherwise(0.0) + 1.0

    one = one.withColumn("gram", F.transform("ex", lambda a: F.transform("ex", lambda b: likeness(a, b))))
    one = one.agg(F.first("ex").alias("ex"), F.first("gram").alias("gram"))  # computed once, not in every step

    def step(alpha: Column, _: Column) -> Column:
        def moved(pair: Column) -> Column:
            margin = F.aggregate(F.zip_with(alpha, pair["g"], lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x)
            error = 1.0 / (1.0 + F.exp(-margin)) - pair["e"]["y"]
            return pair["a"] * (1.0 - RATE * DECAY) - RATE * error / F.size("ex")

        return F.transform(F.arrays_zip(F.col("ex").alias("e"), F.col("gram").alias("g"), alpha.alias("a")), moved)

    start = F.transform("ex", lambda _: F.lit(0.0))
    one = one.select("ex", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("alpha"))
    each = one.select(F.explode(F.arrays_zip("ex", "alpha")).alias("r")).select(
        F.col("r.ex.f").alias("f"), F.col("r.alpha").alias("alpha")
    )
    buckets = each.select(F.explode("f").alias("bucket"), (F.col("alpha") / F.sqrt(F.size("f"))).alias("weight"))
    bias = each.select(F.lit(-1).alias("bucket"), F.col("alpha").alias("weight"))
    return buckets.unionByName(bias).groupBy("bucket").agg(F.sum("weight").alias("weight"))


def margin(host: Column, path: Column, weights: DataFrame) -> Column:
    """Log odds of block. ``weights`` has at most ``BUCKETS`` + 1 rows."""
    found = {r["bucket"]: r["weight"] for r in weights.collect()}
    dense = F.split(F.lit(",".join(repr(found.get(b, 0.0)) for b in range(BUCKETS))), ",").cast(T.ArrayType(T.DoubleType()))
    mine = features(host, path)
    total = F.aggregate(mine, F.lit(0.0), lambda s, b: s + F.get(dense, b))
    return F.when(F.size(mine) > 0, total / F.sqrt(F.size(mine))).otherwise(0.0) + F.lit(found.get(-1, 0.0))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (probability of block).

    A null URL or one without ``://`` has an empty host and path: no rule fits, and the
    intercept alone decides. Repeated rows are judged alike, extra columns stay, and columns
    of the input named like a result are replaced. An empty label table blocks nothing.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    odds = margin(host, path, train(labels))
    name, verdict = rule_columns(host, path, rules)
    results = ("host", "path", "rule", "verdict", "score")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in results or c == url]
    judged = pages.select(
        *kept, host.alias("host"), path.alias("path"), name.alias("rule"), verdict.alias("verdict"), odds.alias("score")
    )
    by_model = F.when(F.col("score") > 0, "block").otherwise("allow")
    return judged.withColumns(
        {"verdict": F.coalesce("verdict", by_model), "score": 1.0 / (1.0 + F.exp(-F.col("score")))}
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled(spark)).select("page_id", "host", "path", "rule", "verdict", "score")
