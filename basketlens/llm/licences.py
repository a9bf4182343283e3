"""Licence scan: Aho-Corasick over tags and notice phrases, and a shunting-yard parser for expressions.

Each text is scanned once, in Arrow batches, without a shuffle. Two automata are built once per
worker: one finds identifier tags in the text, one finds notice phrases in its words. What
follows a tag is parsed as a licence expression (and, or, with, parentheses) into postfix order,
and evaluated against a set of permissive licences.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.tables import table

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notices, as words, with their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit-style",
    "redistribution and use in source and binary forms": "bsd-style",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license": "gnu-gpl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "apache license version 2 0": "apache-2.0",
    "academic free license": "afl",
    "artistic license": "artistic",
    "business source license": "busl",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons zero": "cc0",
    "european union public licence": "eupl",
    "free documentation license": "gfdl",
    "microsoft public license": "ms-pl",
    "open data commons": "odc",
    "open database license": "odbl",
    "open software license": "osl",
    "postgresql license": "postgresql",
    "python software foundation license": "psf",
    "server side public license": "sspl",
    "sil open font license": "ofl",
    "this is free and unencumbered software": "unlicense",
    "zlib license": "zlib",
}
TAGS = ("spdx-license-identifier", "license-expression", "licence-expression")

PERMISSIVE = frozenset(
    "0bsd apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-4.0 cc0-1.0 isc mit mit-0 unlicense zlib".split()
)
#: Exceptions that lift the copyleft of the licence they are attached to for those who link to it.
LIFTING = frozenset("classpath-exception-2.0 gcc-exception-3.1 llvm-exception linux-syscall-note".split())

# Identifiers that a tag may name, in lower case, and exceptions that may follow "with".
LICENCES = frozenset("""
    0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0
    artistic-1.0 artistic-1.0-perl artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause
    bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0
    cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-2.0
    cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cern-ohl-p-2.0 cern-ohl-s-2.0
    cern-ohl-w-2.0 cpal-1.0 cpl-1.0 curl ecl-2.0 efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3
    gfdl-1.3-only gfdl-1.3-or-later gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0
    gpl-3.0-only gpl-3.0-or-later hpnd icu ijg isc json lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only
    lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng libpng-2.0 libtiff lppl-1.3c mit mit-0 mit-cmu mpl-1.1
    mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa netcdf nposl-3.0 ntp odbl-1.0 odc-by-1.0 ofl-1.0
    ofl-1.1 openssl osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat spl-1.0
    sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zend-2.0 zlib zpl-2.0 zpl-2.1
""".split())  # fmt: skip
EXCEPTIONS = frozenset("""
    autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0
    ecos-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-3.0-linking-exception
    libtool-exception linux-syscall-note llvm-exception openvpn-openssl-exception qt-gpl-exception-1.0
    qt-lgpl-exception-1.1 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())  # fmt: skip
#: How sure one label is that the text carries licence terms, by where it was found.
BASE_WEIGHT, NOTICE_WEIGHT, TAG_WEIGHT = 0.6, 0.7, 0.95

BINDING = {"or": 1, "and": 2, "with": 3}
NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?))")
RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "expressions array<string>, permissive boolean, score double"
)


def is_known(name: str, exception: bool) -> bool:
    """Is it an exception, or else a licence: listed, of a later version (+), or one that the project defines?"""
    return name in EXCEPTIONS if exception else name.removesuffix("+") in LICENCES or name.startswith("licenseref-")


def expression_tokens(text: str, at: int, known: Callable[[str, bool], bool] | None = None) -> list[str]:
    """The longest run of tokens from ``at`` on the same line that alternates as an expression does.

    ``known(name, after_with)`` says which names may stand in it; left out, all may.
    """
    tokens: list[str] = []
    operand, depth = True, 0  # what is expected next, and open parentheses
    while match := TOKEN.match(text, at):
        bracket, word = match.groups()
        lower = word.lower() if word else None
        if bracket == "(" and operand:
            depth += 1
        elif bracket == ")" and not operand and depth:
            depth -= 1
        elif lower in BINDING and not operand:
            operand = True
        elif word and lower not in BINDING and operand and (known is None or known(lower, tokens[-1:] == ["with"])):
            operand = False
        else:
            break
        tokens.append(bracket or lower)
        at = match.end()
    return tokens


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if it is no expression."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in BINDING:
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    while held:
        if (top := held.pop()) == "(":
            return None
        out.append(top)
    return out or None


def evaluate(rpn: list[str], allowed: frozenset[str] = PERMISSIVE) -> bool | None:
    """May the text be used under licences in ``allowed`` alone? None if it is no expression."""
    stack: list[tuple[bool, str | None]] = []
    for token in rpn:
        if token not in BINDING:
            stack.append((token.removesuffix("+") in allowed, token))
            continue
        if len(stack) < 2:
            return None
        (right, name), (left, licence) = stack.pop(), stack.pop()
        if token == "with":
            if name is None or licence is None:
                return None
            stack.append((left or name in LIFTING, None))
        else:
            stack.append((left and right if token == "and" else left or right, None))
    return stack[0][0] if len(stack) == 1 else None


@cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    tags, phrases = ahocorasick.Automaton(), ahocorasick.Automaton()
    for tag in TAGS:
        tags.add_word(tag, tag)
    for phrase, label in (BASE | NOTICES).items():
        phrases.add_word(f" {phrase} ", (phrase in BASE, label, phrase.count(" ") + 1))
    tags.make_automaton()
    phrases.make_automaton()
    return tags, phrases


def scan_text(text: str) -> tuple:
    """A row of ``RESULT`` for one whole text."""
    tags, phrases = _automata()
    lower = text.encode("utf-8", "replace").lower().decode()  # A-Z only
    words = NOT_WORD.sub(" ", lower).strip(" ")
    base, own = set(), set()
    n_base, first, last = 0, None, None
    spaces, seen = 0, 0
    line = f" {words} "
    for end, (is_base, label, length) in phrases.iter(line):
        if not is_base:
            own.add(label)
            continue
        spaces, seen = spaces + line.count(" ", seen, end), end
        at = spaces - length
        n_base, first, last = n_base + 1, at if first is None else min(first, at), at if last is None else max(last, at)
        base.add(label)
    expressions, verdicts, tagged = [], [], set()
    for end, _ in tags.iter(lower):
        at = end + 1
        while at < len(lower) and lower[at] in " \t:=\"'":
            at += 1
        tokens = expression_tokens(lower, at, is_known)
        while tokens and (tokens[-1] in BINDING or tokens[-1] == "("):
            tokens.pop()
        rpn = postfix(tokens)
        verdict = evaluate(rpn) if rpn else None
        if verdict is not None:
            expressions.append(" ".join(tokens))
            verdicts.append(verdict)
            tagged |= {t for t in rpn if t not in BINDING}
    doubt = (1 - BASE_WEIGHT) ** len(base) * (1 - NOTICE_WEIGHT) ** len(own) * (1 - TAG_WEIGHT) ** len(tagged)
    return (
        words.count(" ") + 1 if words else 0,
        n_base,
        first,
        last,
        ",".join(sorted(base)),
        ",".join(sorted(base | own | tagged)),
        expressions,
        all(verdicts) if verdicts else None,
        1.0 - doubt,
    )


def scan(text: Column) -> Column:
    """A struct of ``RESULT`` for every text."""

    @F.pandas_udf(RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            out = pd.DataFrame([scan_text(t) for t in batch], columns=names, dtype=object)
            yield out.assign(**{c: out[c].astype("Int64") for c in names[:4]})

    return scanned(F.coalesce(text, F.lit("")))


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RESULT``.

    Null is an empty text: no words, empty labels, score 0. What follows a tag is read as far as it is
    an expression of known licences and exceptions; tags without one count for nothing. Repeated rows give equal rows; columns named like a result are replaced.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, scan(F.col(text)).alias("_found")).select(*kept, "_found.*")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive"
    )
