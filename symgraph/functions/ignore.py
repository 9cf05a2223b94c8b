"""Ignore rules of a source tree: patterns with *, ?, **, [..], a leading ! or /, a trailing /."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Directories that are never entered.
BUILT_IN = (".git", "node_modules", "__pycache__", ".venv", "venv")


@dataclass(frozen=True)
class Rule:
    base: str  # the directory that the rules file lies in, "" for the root
    pattern: str
    keep: bool
    dirs_only: bool
    anchored: bool

    def fits(self, path: str, is_dir: bool) -> bool:
        if self.dirs_only and not is_dir:
            return False
        if self.base:
            if not path.startswith(self.base + "/"):
                return False
            path = path[len(self.base) + 1 :]
        return re.fullmatch(self.pattern, path) is not None


def _regex(glob: str, anchored: bool) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out if anchored else "(?:.*/)?" + out


def compile_rules(text: str, base: str = "") -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:]
        dirs_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        if line:
            rules.append(Rule(base, _regex(line, anchored), keep, dirs_only, anchored))
    return rules


def ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """The last rule that fits decides."""
    for rule in reversed(rules):
        if rule.fits(path, is_dir):
            return not rule.keep
    return False


def selected(path: str, include: list[str], exclude: list[str]) -> bool:
    """Include patterns first (none: all), then exclude patterns."""
    hit = lambda patterns: any(ignored(p, p != path, compile_rules("\n".join(patterns))) for p in _ancestors(path))
    return (not include or hit(include)) and not (exclude and hit(exclude))


def _ancestors(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[: i + 1]) for i in range(len(parts))]
