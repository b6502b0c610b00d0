"""Ordered regular-expression cleanup of string columns, as nested native expressions.

Patterns are written in a linear-time dialect: no lookaround, no backreferences, no
possessive or atomic groups. Classes such as \\s and \\w are Unicode; ``$`` is the end
of the text, unless the pattern switches to lines. In replacements ``$1``, ``$name``
and ``${name}`` stand for groups (an unknown one for nothing) and ``$$`` for a dollar.
Patterns are translated to the JVM's dialect and compiled once when a rule is made.

One difference is left: where a pattern also matches nothing, the JVM finds an empty
match directly behind a match; linear-time engines don't.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, SchemaMismatch
from ..metrics import instrumented
from ..resolve import col, quoted, registered, string_field

# Escapes that mean the same in both dialects, and Unicode white space.
_SAME_ESCAPES = set("dDsSwWbBtnrfaAz\\.+*?()|[]{}^$#&-~/:;<>=!,%@'\"` _")
WHITE_SPACE = r"\t-\r \x{85}\p{Z}"
# The ASCII classes in brackets.
_POSIX = {
    "alpha": "a-zA-Z", "digit": "0-9", "alnum": "0-9a-zA-Z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "blank": r"\t ",
    "punct": r"!-/:-@\[-`{-~", "cntrl": r"\x00-\x1F\x7F", "xdigit": "0-9A-Fa-f", "word": "0-9A-Za-z_", "ascii": r"\x00-\x7F", "graph": "!-~", "print": " -~",
}


@dataclass(frozen=True)
class _Translated:
    pattern: str
    names: dict[str, int] = field(default_factory=dict)
    groups: int = 0


def translate_pattern(pattern: str) -> _Translated:
    """The JVM's form of a pattern; what isn't understood is refused."""
    out, names, groups, at, in_class, lines = [], {}, 0, 0, 0, False

    def refuse(why: str):
        raise ConfigError(f"pattern {pattern!r}: {why} at {at}")

    while at < len(pattern):
        rest, c = pattern[at:], pattern[at]
        if c == "\\":
            if len(rest) < 2:
                refuse("a lone backslash")
            e = rest[1]
            if m := re.match(r"\\[pP](?:\{\^?(\w+)(?:=(\w+))?\}|(\w))", rest):
                name = m[2] or m[1] or m[3]
                negated = (rest[1] == "P") != ("^" in m[0])
                # One or two letters are a general category, more a script or property.
                out.append(f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}")
            elif m := re.match(r"\\[xuU]\{([0-9A-Fa-f]+)\}|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", rest):
                out.append(f"\\x{{{m[1] or m[2] or m[3] or m[4]}}}")
            elif e == "v":
                m = re.match(r"\\v", rest)
                out.append(r"\x0B")
            elif e in _SAME_ESCAPES and not (in_class and e in "bBAz"):
                m = re.match(r"\\.", rest, re.DOTALL)
                out.append(m[0])
            else:
                refuse(f"\\{e} is not part of the dialect")
            at += len(m[0])
        elif in_class:
            if m := re.match(r"\[:(\^?)(\w+):\]", rest):
                if m[2] not in _POSIX:
                    refuse(f"unknown class {m[2]}")
                out.append(f"[{m[1]}{_POSIX[m[2]]}]")
                at += len(m[0])
                continue
            if rest.startswith(("--", "~~")):
                refuse("class differences are not supported")
            in_class += {"[": 1, "]": -1}.get(c, 0)
            out.append(c)
            at += 1
            if c == "[" and pattern[at : at + 1] == "^":
                out.append("^")
                at += 1
            if c == "[" and pattern[at : at + 1] == "]":
                out.append(r"\]")
                at += 1
        elif c == "[":
            in_class = 1
            out.append(c)
            at += 1
            if pattern[at : at + 1] == "^":
                out.append("^")
                at += 1
            if pattern[at : at + 1] == "]":
                out.append(r"\]")
                at += 1
        elif c == "(":
            if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", rest):
                groups += 1
                if m[1] in names:
                    refuse(f"group {m[1]} comes twice")
                names[m[1]] = groups
                out.append("(")
            elif m := re.match(r"\(\?([imsx]*)(?:-([imsx]+))?(\)|:)", rest):
                if not m[1] and not m[2] and m[3] == ")":
                    refuse("empty flags")
                lines |= "m" in m[1]
                # Letters differ in case as Unicode has it.
                on, off = m[1].replace("i", "iu"), (m[2] or "").replace("i", "iu")
                out.append(f"(?{on}{'-' + off if off else ''}{m[3]}")
            elif rest.startswith("(?"):
                refuse("lookaround, atomic groups and other flags are not part of the dialect")
            else:
                m = re.match(r"\(", rest)
                groups += 1
                out.append("(")
            at += len(m[0])
        elif c in "*+?}" and rest[1:2] == "+":
            refuse("possessive quantifiers are not part of the dialect")
        elif c == "$":
            out.append("$" if lines else r"\z")
            at += 1
        else:
            out.append(c)
            at += 1
    # U: classes and case by Unicode; d: only \n ends a line.
    return _Translated("(?Ud)" + "".join(out), names, groups)


def translate_replacement(replacement: str, names: dict[str, int], groups: int) -> str:
    """The JVM's form of a replacement."""
    out, at = [], 0
    while at < len(replacement):
        c = replacement[at]
        if replacement.startswith("$$", at):
            out.append(r"\$")
            at += 2
        elif m := re.match(r"\$(?:\{([^}]+)\}|([0-9A-Za-z_]+))", replacement[at:]):
            name = m[1] or m[2]
            number = int(name) if name.isdecimal() and name.isascii() else names.get(name, -1)
            at += len(m[0])
            if 0 <= number <= groups:
                out.append(f"${number}")
                # A digit behind a group's number would be read as part of it.
                if replacement[at : at + 1].isdecimal():
                    out.append("\\" + replacement[at])
                    at += 1
        else:
            out.append("\\" + c if c in "\\$" else c)
            at += 1
    return "".join(out)


@dataclass(frozen=True)
class CleanRule:
    """Replace every match of pattern."""

    pattern: str
    replacement: str
    _java: tuple[str, str] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        found = translate_pattern(self.pattern)
        object.__setattr__(self, "_java", (found.pattern, translate_replacement(self.replacement, found.names, found.groups)))
        context = SparkContext._active_spark_context
        if context is not None and context._jvm is not None:
            try:
                context._jvm.java.util.regex.Pattern.compile(found.pattern)
            except Exception as e:
                raise ConfigError(f"pattern {self.pattern!r} does not compile") from e

    def on(self, c: Column) -> Column:
        pattern, replacement = self._java
        return F.regexp_replace(c, pattern, replacement)


def apply_rules(c: Column, rules: Sequence[CleanRule | tuple[str, str]]) -> Column:
    """Each rule on what the one before left; null stays null."""
    for rule in rules:
        c = (rule if isinstance(rule, CleanRule) else CleanRule(*rule)).on(c)
    return c


# The presets of version v1.
_PRESETS = {
    "v1": {
        "trim_whitespace": (rf"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", ""),
        "collapse_whitespace": (rf"[{WHITE_SPACE}]+", " "),
        "strip_control_characters": (r"[\x00-\x1F\x7F]", ""),
        "strip_non_alphanumeric": (rf"[^A-Za-z0-9{WHITE_SPACE}]", ""),
        "digits_only": (r"[^0-9]", ""),
    }
}


def preset(name: str, version: str = "v1") -> CleanRule:
    found = registered(_PRESETS, version, "cleanup")
    if name not in found:
        raise ValueError(f"unknown preset {name!r}; there are {sorted(found)}")
    return CleanRule(*found[name])


def _cleaned(df: DataFrame, column: str, rules: Sequence[CleanRule | tuple[str, str]], output_column: str | None) -> DataFrame:
    string_field(df, column)
    made = apply_rules(col(column), rules)
    if output_column is None or output_column == column:
        return df.select(*[made.alias(n) if n == column else col(n) for n in df.columns])
    if output_column in df.columns:
        raise SchemaMismatch(f"there is a column {output_column!r}")
    return df.select(*[quoted(n) for n in df.columns], made.alias(output_column))


@instrumented
def clean_with_rules(df: DataFrame, column: str, rules: Sequence[CleanRule | tuple[str, str]], output_column: str | None = None) -> DataFrame:
    """df with the column cleaned, in place or as a last column."""
    return _cleaned(df, column, rules, output_column)


@instrumented
def clean_with_preset(df: DataFrame, column: str, name: str, output_column: str | None = None, version: str = "v1") -> DataFrame:
    """The same with a preset's rule."""
    return _cleaned(df, column, [preset(name, version)], output_column)
