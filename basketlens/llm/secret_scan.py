"""Secret scan: base patterns, and weak parts of credentials that count only together.

A weak part alone (a user name, a short password-like value, an address of a service) says
little. Each is an interval in its text with a scope: the paragraph it stands in. An interval
join brings parts together with the scopes they lie in; a weak part is reported only if its complements are there:

- a weak secret needs an access identifier,
- an access identifier (weak) needs a secret, strong or weak,
- an endpoint needs an access identifier and a secret.

Parts are found in Arrow batches. The join deals positions in buckets, so a part meets only scopes of its own
bucket, whose number is bounded by the bucket's width: the join grows with the parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.tables import few, table
from basketlens.sources.scratch import written

# The base patterns; letters of the first group in either case.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex")

#: Weak parts: a key (any prefix, then one of these names), a sign of assignment and a value, by the kind of their spans.
KEY = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)[\"']?[ \t]*+[:=][ \t]*+")
WEAK = {
    "identifier": (
        re.compile(r"(?i:user(?:[_.-]?name)?|login|client[_.-]?id|access[_.-]?key[_.-]?id|account)\Z"),
        re.compile(r"[\"']?[\w.@+-]{2,}"),
    ),
    "weak_secret": (
        re.compile(
            r"(?i:pwd|pass|passphrase|credential|auth|password|passwd|secret|token"
            r"|(?:api|private|client|secret|secret[_.-]?access)[_.-]?key)\Z"
        ),
        re.compile(r"\"[^\"\r\n]{4,}(?=\")|'[^'\r\n]{4,}(?=')|[\"']?[^\s\"',;]{4,}"),
    ),
    "endpoint": (re.compile(r"(?i:host|endpoint|server)\Z"), re.compile(r"[\"']?[\w.-]{3,}")),
}
ADDRESS = re.compile(r"(?i:\bhttps?|\bjdbc:[a-z]+|\bamqps?|\bs3|\bpostgres(?:ql)?|\bmongodb)://[\w.-]+(?::[0-9]{1,5})?")
#: What a part of a kind stands for when complements are looked for.
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "identifier": "id", "endpoint": "endpoint"}
ORDER = (*KINDS, *WEAK)
# Code points that a bucket of the interval join spans.
BUCKET = 4_096
REST = re.compile(r"\w")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

PART = "struct<kind:string,start:long,end:long,scope_start:long,scope_end:long>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    """Keys with their values, and addresses; parts of one kind do not overlap."""
    found = [("endpoint", *m.span()) for m in ADDRESS.finditer(text)]
    addresses, ends = iter(found.copy()), dict.fromkeys(WEAK, 0)
    ahead = next(addresses, None)
    for m in KEY.finditer(text):
        for kind, (name, value) in WEAK.items():
            if m.start() >= ends[kind] and name.search(m[1]) and (v := value.match(text, m.end())):
                while ahead and ahead[2] <= m.start():
                    ahead = next(addresses, None)
                if kind != "endpoint" or not ahead or ahead[1] >= v.end():
                    found.append((kind, m.start(), v.end()))
                    ends[kind] = v.end()
    return found


def find_parts(text: str) -> list[tuple[str, int, int, int, int]]:
    """All base and weak parts with the paragraph each stands in, by start and kind."""
    found = base_spans(text)
    taken = sorted((s, e) for _, s, e in found)
    found += weak_spans(text)
    if not found:
        return []
    found.sort(key=lambda p: (p[1], ORDER.index(p[0]), p[2]))
    if not any(k in WEAK for k, _, _ in found):
        return [(k, s, e, 0, len(text)) for k, s, e in found]
    breaks = [(m.start(), m.end()) for m in PARAGRAPH.finditer(text)]
    out, at, low, i = [], 0, 0, 0
    for kind, start, end in found:
        while at < len(breaks) and breaks[at][1] <= start:
            low, at = breaks[at][1], at + 1
        if kind in WEAK:
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            # Part of a base span; a secret that goes on behind it has its end only here.
            if i < len(taken) and taken[i][0] < end and (kind != "weak_secret" or not REST.search(text, taken[i][1], end)):
                continue
        out.append((kind, start, end, low, breaks[at][0] if at < len(breaks) else len(text)))
    return out


def parts(text: Column) -> Column:
    @F.pandas_udf(f"array<{PART}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "scope_start", "scope_end")
        for batch in batches:
            yield pd.Series([[dict(zip(names, p, strict=True)) for p in find_parts(t)] for t in batch], dtype=object)

    return found(F.coalesce(text, F.lit("")))


def link_parts(rows: DataFrame, key: str, width: int = BUCKET) -> DataFrame:
    """``key, kind, start, end`` of the weak parts of ``rows.parts`` whose complements stand in their scope.

    ``key`` stands for the text, and a paragraph is a scope: an interval of its positions. The first interval join
    puts parts into scopes, which tells the scopes that hold an identifier and a secret; the second finds the
    weak parts in those. Positions are dealt in buckets of ``width``: a part is in the one it starts in, a
    scope in all that it reaches, so no pairs of parts are made, however long a scope is.
    """
    # Without a weak part there is nothing to link.
    weak = rows.where(F.exists("parts", lambda p: p["kind"].isin(*WEAK))).select(key, F.explode("parts").alias("p"))
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    each = weak.select(key, "p.*", role[F.col("p.kind")].alias("role"), F.floor(F.col("p.start") / width).alias("bucket"))
    scopes = each.select(key, "scope_start", "scope_end").distinct()
    inside = _within(scopes, each.select(key, "bucket", "start", "end", "role"), key, width)
    has = lambda role: F.max(F.col("role") == role)
    full = inside.groupBy(key, "scope_start", "scope_end").agg(has("id").alias("has_id"), has("secret").alias("has_secret"))
    # An endpoint needs both, and an identifier or a secret is one of the two itself.
    full = full.where("has_id and has_secret").select(key, "scope_start", "scope_end")
    found = _within(full, each.where(F.col("kind").isin(*WEAK)).select(key, "bucket", "start", "end", "kind"), key, width)
    return found.select(key, "kind", "start", "end")


def _within(scopes: DataFrame, parts: DataFrame, key: str, width: int) -> DataFrame:
    """Interval join: the parts that lie in a scope of the same text."""
    reached = F.sequence(F.floor(F.col("scope_start") / width), F.floor(F.col("scope_end") / width))
    dealt = scopes.select(key, "scope_start", "scope_end", F.explode(reached).alias("bucket"))
    return dealt.join(parts, [key, "bucket"]).where((F.col("start") >= F.col("scope_start")) & (F.col("end") <= F.col("scope_end")))


def scan_secrets(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (kind, start, end) by start, then kind.

    Base spans are always there, weak ones only when their complements co-occur. Null is an
    empty text without spans. Rows are told apart by all their columns; rows that repeat entirely get equal results. A column named secret_spans is replaced. ``keep_text=False``
    leaves the text out of the result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("secret_spans", "_key", "parts")]
    names = [F.col(f"`{c}`") for c in kept if keep_text or c != text]
    # Rows with equal text and id may meet in the join; what they link there is the same.
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")), *[F.col(f"`{c}`").cast("string") for c in kept if c != text])
    rows = docs.select(*names, parts(F.col(text)).alias("parts"), key.alias("_key"))
    rows = written(rows, "secret-parts")
    linked = link_parts(_one_each(rows), "_key")
    spans = linked.groupBy("_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("_weak"))
    spans = few(written(spans, "secret-links"))  # broadcast if there are few: the texts stay where they are
    base = F.transform(
        F.filter("parts", lambda p: p["kind"].isin(*KINDS)),
        lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")),
    )
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(ORDER) for x in (k, i)])
    every = F.transform(
        F.array_sort(
            F.transform(
                F.concat(base, F.coalesce("_weak", F.array().cast("array<struct<kind:string,start:long,end:long>>"))),
                lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
            )
        ),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return rows.join(spans, "_key", "left").select(*names, every.alias("secret_spans"))


def _one_each(rows: DataFrame) -> DataFrame:
    """The rows with weak parts, each key once; map-side, so copies do not travel."""
    weak = rows.where(F.exists("parts", lambda p: p["kind"].isin(*WEAK)))
    return weak.groupBy("_key").agg(F.first("parts").alias("parts"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mask``; overlapping spans are replaced together."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.when(
            s["start"] >= state["at"],
            F.concat(F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mask)),
        ).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], gap).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    rest = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
