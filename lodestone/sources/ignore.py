"""Ignore rules in the syntax of .gitignore, as predicates on path columns: the last rule that matches decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool
    directories_only: bool


def glob_pattern(glob: str) -> str:
    """A glob over path parts as a regular expression: ** crosses slashes, * and ? don't."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif glob[k:] == "**" and (k == 0 or glob[k - 1] == "/"):
            out, k = out + ".+", k + 2
        elif c == "*":
            while glob.startswith("*", k):
                k += 1
            out += "[^/]*"
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            if c == "\\" and k + 1 < len(glob):
                k, c = k + 1, glob[k + 1]
            out, k = out + (c if c.isalnum() or c in "/_-" else "\\" + c), k + 1
    return out


def parse_rules(lines: list[str], base: str = "") -> list[Rule]:
    """Rules of a file in the directory `base` (relative, "" for the root). Blank lines and comments give none."""
    rules = []
    for line in lines:
        text = line.rstrip("\r\n")
        text = text if text.endswith("\\ ") else text.rstrip(" ")
        if not text or text.startswith("#"):
            continue
        negated = text.startswith("!")
        text = text[negated:]
        only = text.endswith("/")
        text = text.rstrip("/")
        anchored = "/" in text
        body = glob_pattern(text.lstrip("/"))
        where = "".join(f"\\{c}" if not c.isalnum() and c not in "/_-" else c for c in base + "/" * bool(base))
        if body:
            rules.append(Rule(f"^{where}{'' if anchored else '(?:.*/)?'}{body}$", negated, only))
    return rules


def is_ignored(path: Column, rules: list[Rule], *, directory: bool = False) -> Column:
    """Whether the rules ignore this path (relative to their root), not looking at its parents."""
    out = F.lit(False)
    for rule in rules:
        if directory or not rule.directories_only:
            out = F.when(path.rlike(rule.pattern), F.lit(not rule.negated)).otherwise(out)
    return out


def is_excluded(path: Column, rules: list[Rule]) -> Column:
    """Whether the rules ignore this file or any directory that it lies in."""
    parts = F.split(path, "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.exists(parents, lambda p: is_ignored(p, rules, directory=True))
    return (F.when(F.size(parts) > 1, above).otherwise(F.lit(False))) | is_ignored(path, rules)
