"""Three-valued platform conditions: true, false or unknown (null) for each target."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What each target is, by key of a condition.
TARGETS = {
    "linux": {"os": ["linux", "unix"], "arch": ["x86_64"], "family": ["unix"]},
    "macos": {"os": ["macos", "darwin", "unix"], "arch": ["aarch64"], "family": ["unix"]},
    "windows": {"os": ["windows"], "arch": ["x86_64"], "family": ["windows"]},
    "android": {"os": ["android", "linux", "unix"], "arch": ["aarch64"], "family": ["unix", "mobile"]},
    "ios": {"os": ["ios", "darwin", "unix"], "arch": ["aarch64"], "family": ["unix", "mobile"]},
    "web": {"os": ["web"], "arch": ["wasm32"], "family": ["web"]},
}


def atom(key: Column, value: Column, target: str) -> Column:
    """Whether key = value holds on a target; unknown for keys that aren't about platforms."""
    facts = TARGETS[target]
    out = F.when(F.lit(False), F.lit(True))
    for k, values in facts.items():
        out = out.when(key == k, F.lower(value).isin(values))
    return out


def all_of(conditions: Column) -> Column:
    """Of an array of three-valued conditions; of none, true."""
    return F.when(F.exists(conditions, lambda c: ~c), False).when(F.exists(conditions, lambda c: c.isNull()), F.lit(None).cast("boolean")).otherwise(True)


def any_of(conditions: Column) -> Column:
    """Of an array of three-valued conditions; of none, unknown."""
    some = F.exists(conditions, lambda c: F.coalesce(c, F.lit(False)))
    unknown = (F.size(conditions) == 0) | F.exists(conditions, lambda c: c.isNull())
    return F.when(some, True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)


def excluded(conditions: Column) -> Column:
    """Only what is certainly false on a target is left out."""
    return F.coalesce(~conditions, F.lit(False))


# Macros of each target: "1" or "0" where the target says so, None where it depends; and macros of other systems.
MACROS = {
    "windows": {"_WIN32": "1", "WIN32": "1", "__WIN32__": "1", "_WINDOWS": None, "_WIN64": None, "_MSC_VER": None, "__MINGW32__": None, "__MINGW64__": None, "__CYGWIN__": None},
    "linux": {"__linux__": "1", "__linux": "1", "linux": None, "__gnu_linux__": "1", "__unix__": "1", "__unix": "1", "unix": None, "__GLIBC__": None},
    "android": {"__linux__": "1", "__linux": "1", "linux": None, "__ANDROID__": "1", "ANDROID": None, "__BIONIC__": "1", "__unix__": "1", "__unix": "1", "unix": None, "__ANDROID_API__": None},
    "macos": {"__APPLE__": "1", "__MACH__": "1", "TARGET_OS_MAC": "1", "TARGET_OS_OSX": "1", "TARGET_OS_IPHONE": "0", "TARGET_OS_IOS": "0", "TARGET_OS_SIMULATOR": "0", "TARGET_OS_TV": "0", "TARGET_OS_WATCH": "0", "__APPLE_CC__": None},
    "ios": {"__APPLE__": "1", "__MACH__": "1", "TARGET_OS_MAC": "1", "TARGET_OS_OSX": "0", "TARGET_OS_IPHONE": "1", "TARGET_OS_IOS": "1", "TARGET_OS_SIMULATOR": None, "TARGET_OS_TV": "0", "TARGET_OS_WATCH": "0", "__APPLE_CC__": None},
    "web": {"__EMSCRIPTEN__": "1", "EMSCRIPTEN": None, "__wasm__": "1", "__wasm32__": None, "__wasm64__": None, "__unix__": "1", "__unix": "1", "unix": None},
}
OTHER_SYSTEMS = ["__FreeBSD__", "__OpenBSD__", "__NetBSD__", "__DragonFly__", "__sun", "__sun__", "_AIX", "__HAIKU__", "__Fuchsia__", "__QNX__"]
KNOWN_MACROS = {m for facts in MACROS.values() for m in facts} | set(OTHER_SYSTEMS)

_TOKEN = re.compile(r"defined\s*\(\s*(\w+)\s*\)|defined\s+(\w+)|(&&|\|\||==|!=|>=|<=|[!()<>])|(\w+)|\s+|(.)")


def _not(x: bool | None) -> bool | None:
    return None if x is None else not x


def holds(expression: str | None, target: str) -> bool | None:
    """Whether a preprocessor condition holds on a target: true, false, or unknown, as is what isn't read."""
    facts = MACROS[target]

    def defined(name: str) -> bool | None:
        return None if facts.get(name, "") is None else name in facts or (False if name in KNOWN_MACROS else None)

    def value(name: str) -> int | None:
        if name.isdigit():
            return int(name)
        if name in facts:
            return None if facts[name] is None else int(facts[name])
        return 0 if name in KNOWN_MACROS else None

    tokens = []
    for m in _TOKEN.finditer(expression or ""):
        if m[1] or m[2]:
            tokens.append(("test", m[1] or m[2]))
        elif m[3]:
            tokens.append(("sign", m[3]))
        elif m[4]:
            tokens.append(("name", m[4]))
        elif m[5]:
            return None
    at = 0

    def sign(*which: str) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at][0] == "sign" and tokens[at][1] in which:
            at += 1
            return tokens[at - 1][1]
        return None

    def one() -> bool | None:
        nonlocal at
        if sign("!"):
            return _not(one())
        if sign("("):
            inner = either()
            if not sign(")"):
                raise ValueError("a bracket is open")
            return inner
        if at >= len(tokens) or tokens[at][0] == "sign":
            raise ValueError("a term is missing")
        kind, name = tokens[at]
        at += 1
        if kind == "test":
            return defined(name)
        left = value(name)
        compared = sign("==", "!=", ">=", "<=", "<", ">")
        if not compared:
            return None if left is None else left != 0
        if at >= len(tokens) or tokens[at][0] != "name":
            raise ValueError("a term is missing")
        right = value(tokens[at][1])
        at += 1
        if left is None or right is None:
            return None
        return {"==": left == right, "!=": left != right, ">=": left >= right, "<=": left <= right, "<": left < right, ">": left > right}[compared]

    def both() -> bool | None:
        out = one()
        while sign("&&"):
            other = one()
            out = False if out is False or other is False else None if out is None or other is None else True
        return out

    def either() -> bool | None:
        out = both()
        while sign("||"):
            other = both()
            out = True if out or other else None if out is None or other is None else False
        return out

    try:
        out = either()
    except (ValueError, RecursionError):
        return None
    return out if at == len(tokens) else None


def condition(expression: Column, target: str) -> Column:
    """holds() of a column, in Arrow batches."""

    @F.pandas_udf("boolean")
    def each(text: pd.Series) -> pd.Series:
        return pd.Series([holds(x, target) for x in text], dtype="object")

    return each(expression)
