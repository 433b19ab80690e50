"""Ignore rules in the syntax of .gitignore files, as one regular expression where they have no negation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_IGNORE


def pattern_regex(pattern: str) -> tuple[str, bool]:
    """A regular expression for whole relative paths (a folder's ends with /), and whether the pattern takes paths back."""
    negated = pattern.startswith("!")
    p = pattern[negated:]
    if p.startswith("\\"):
        p = p[1:]
    folder_only = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out += "(?:[^/]+/)*"
            i += 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out += "/.+"
            i += 3
        elif p.startswith("**", i):
            out += ".*"
            i += 2
        elif p[i] == "*":
            alone = (i == 0 or p[i - 1] == "/") and (i + 1 == len(p) or p[i + 1] == "/")
            out += "[^/]+" if alone else "[^/]*"
            i += 1
        elif p[i] == "?":
            out += "[^/]"
            i += 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end + 1
        else:
            out += re.escape(p[i])
            i += 1
    return f"{'' if anchored else '(?:.*/)?'}{out}{'/' if folder_only else '/?'}", negated


class IgnoreRules:
    """Rules in order; the last that matches a path decides, but nothing below an ignored folder is taken back."""

    def __init__(self, patterns=()):
        self.patterns: list[str] = []
        self.rules: list[tuple[re.Pattern, bool]] = []
        self.add(patterns)

    @classmethod
    def parse(cls, text: str) -> IgnoreRules:
        lines = (x.strip() for x in text.splitlines())
        return cls([x for x in lines if x and not x.startswith("#")])

    @classmethod
    def default(cls) -> IgnoreRules:
        return cls(DEFAULT_IGNORE)

    def add(self, patterns) -> None:
        for p in [patterns] if isinstance(patterns, str) else patterns:
            regex, negated = pattern_regex(p)
            self.patterns.append(p)
            self.rules.append((re.compile(f"(?s){regex}"), negated))

    def decides(self, path: str) -> bool:
        ignored = False
        for rule, negated in self.rules:
            if rule.fullmatch(path):
                ignored = not negated
        return ignored

    def ignores(self, relative: str) -> bool:
        """Whether a path below the root is ignored, itself or by a folder above it. The root and what is outside never are."""
        if not relative or relative.startswith(".."):
            return False
        parts = relative.split("/")
        return any(self.decides("/".join(parts[:i]) + "/") for i in range(1, len(parts))) or self.decides(relative)

    def kept(self, paths: list[str]) -> list[str]:
        return [p for p in paths if not self.ignores(p)]

    def column(self, relative: Column) -> Column:
        if not self.rules:
            return F.lit(False)
        if not any(negated for _, negated in self.rules):
            whole = "|".join(f"(?:{pattern_regex(p)[0].removesuffix('/?').removesuffix('/') if not p.endswith('/') else pattern_regex(p)[0].removesuffix('/')}{'/.*' if p.endswith('/') else '(?:/.*)?'})" for p in self.patterns)
            return relative.rlike(f"(?s)^(?:{whole})$")
        rules = self

        @F.pandas_udf("boolean")
        def ignored(paths: pd.Series) -> pd.Series:
            return paths.map(rules.ignores)

        return ignored(relative)
