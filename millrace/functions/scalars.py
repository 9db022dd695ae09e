"""Ids, cursors, networks, permissions, redaction, dates: the remaining scalar functions."""

from __future__ import annotations

import base64
import ipaddress
import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Crockford's base 32 (fixed value).
GLYPHS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
CURSOR_VERSION = 1
PAGE_DEFAULT, PAGE_MOST = 50, 200


def encode_id(prefix: str, value: str) -> str:
    """A UUID as prefix_ and 26 glyphs."""
    n, out = uuid.UUID(value).int, []
    for _ in range(26):
        out.append(GLYPHS[n & 31])
        n >>= 5
    return f"{prefix}_{''.join(reversed(out)).lower()}"


def decode_id(prefix: str, public: str) -> str | None:
    """The UUID, or None for another prefix, length or glyph."""
    head, _, body = public.partition("_")
    body = body.upper()
    if head != prefix or len(body) != 26 or any(c not in GLYPHS for c in body):
        return None
    n = 0
    for c in body:
        n = n * 32 + GLYPHS.index(c)
    return str(uuid.UUID(int=n)) if n < 1 << 128 else None


def public_id(prefix: str):
    """A column function of UUIDs as text: prefix_ and 26 glyphs, four of them from each 20 bits of the number."""

    def of(ids: Column) -> Column:
        digits = F.lpad(F.lower(F.regexp_replace(ids, "-", "")), 35, "0")
        parts = [F.conv(F.substring(digits, k + 1, 5), 16, 10).cast("int") for k in range(0, 35, 5)]
        glyphs = [F.substr(F.lit(GLYPHS.lower()), (F.shiftright(n, 5 * k) % 32) + 1, F.lit(1)) for n in parts for k in (3, 2, 1, 0)]
        return F.when(F.length(digits) == 35, F.concat(F.lit(f"{prefix}_"), *glyphs[2:]))

    return of


def internal_id(prefix: str):
    """A column function back: the UUID, or null for another prefix, length or glyph, or a number beyond 128 bits."""
    value = {c: k for k, c in enumerate(GLYPHS)}

    def of(public: Column) -> Column:
        body = F.upper(F.substr(public, F.lit(len(prefix) + 2)))
        good = F.startswith(public, F.lit(f"{prefix}_")) & body.rlike(f"^[{GLYPHS}]{{26}}$")
        places = F.create_map(*[F.lit(x) for pair in value.items() for x in pair])
        glyphs = F.transform(F.split(F.concat(F.lit("00"), body), ""), lambda c: places[c])
        parts = [sum((F.get(glyphs, F.lit(k + j)) * (1 << 5 * (3 - j)) for j in range(4)), F.lit(0)) for k in range(0, 28, 4)]
        digits = F.lower(F.concat(*[F.lpad(F.hex(n.cast("long")), 5, "0") for n in parts]))
        cut = [(4, 8), (12, 4), (16, 4), (20, 4), (24, 12)]
        made = F.concat_ws("-", *[F.substring(digits, at, n) for at, n in cut])
        return F.when(good & F.startswith(digits, F.lit("000")), made)

    return of


def uuid7(ms: Column, key: Column) -> Column:
    """A time-ordered UUID (version 7) of an epoch in milliseconds; what is random in it comes from the md5 of a key, so a row that is worked out again gets the same id."""
    time, random = F.lpad(F.lower(F.hex(ms.cast("long"))), 12, "0"), F.md5(key.cast("string").cast("binary"))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substring(random, 4, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(random, 1, 3)), F.concat(variant, F.substring(random, 5, 3)), F.substring(random, 8, 12))


def encode_cursor(**place) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": CURSOR_VERSION, **place}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    """The place; ValueError for what isn't a cursor of this version."""
    try:
        place = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except Exception as e:
        raise ValueError("malformed cursor") from e
    if not isinstance(place, dict) or place.pop("v", None) != CURSOR_VERSION:
        raise ValueError("cursor of another version")
    return place


def page_size(limit: int | None) -> int:
    if limit is None:
        return PAGE_DEFAULT
    if not 1 <= limit <= PAGE_MOST:
        raise ValueError(f"limit must be 1 to {PAGE_MOST}")
    return limit


#: Networks that a crawler must not reach (fixed values).
BLOCKED = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8",
]


def _in_networks(networks: list[str]):
    nets = [ipaddress.ip_network(n) for n in networks]

    @F.pandas_udf("boolean")
    def run(addresses: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            try:
                ip = ipaddress.ip_address(x)
            except ValueError:
                return False
            ip = getattr(ip, "ipv4_mapped", None) or ip
            return any(ip.version == n.version and ip in n for n in nets)

        return addresses.map(one)

    return run


def blocked_address(address: Column) -> Column:
    return _in_networks(BLOCKED)(address)


def allowed_address(address: Column, networks: list[str]) -> Column:
    """An empty list allows every address."""
    return F.lit(True) if not networks else F.coalesce(_in_networks(networks)(address), F.lit(False))


#: What each permission brings with it besides itself (fixed values).
IMPLIES = {
    "kb:manage": ["kb:query", "kb:read", "kb:write"],
    "kb:write": ["kb:query", "kb:read"],
    "kb:read": ["kb:query"],
    "pipeline:edit": ["pipeline:read", "pipeline:run"],
    "function:edit": ["function:use"],
    "model:manage": ["model:use"],
    "eval:run": ["eval:read"],
}
#: Rights over the platform that only administrators hold (fixed values).
PLATFORM = ("platform:users", "platform:models", "platform:storage", "platform:settings", "platform:audit")


def is_platform(permission: Column) -> Column:
    return F.coalesce(permission.isin(*PLATFORM), F.lit(False))


def implied(permissions: Column) -> Column:
    """The permissions and all that they bring, sorted."""
    table = F.create_map(*[x for k, v in IMPLIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(permissions, lambda p: F.coalesce(table[p], F.expr("cast(array() as array<string>)"))))
    return F.array_sort(F.array_distinct(F.concat(permissions, more)))


#: A key that has one of these in it, once its hyphens and spaces are underscores, is secret (fixed values).
SECRET_MARKERS = (
    "password", "passwd", "token", "api_key", "apikey", "secret", "authorization", "credential",
    "private_key", "master_key", "session_id", "cookie",
)


_SECRET = re.compile("|".join(m.replace("_", "[-_ ]") for m in SECRET_MARKERS), re.IGNORECASE)


def _hidden(pairs: list[tuple[str, object]]) -> dict:
    """An object as it is read, innermost first."""
    return {k: "[redacted]" if _SECRET.search(k) else v for k, v in pairs}


@F.pandas_udf(StringType())
def redacted(texts: pd.Series) -> pd.Series:
    """JSON texts with the values of secret keys replaced at any depth; what isn't JSON is kept."""

    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(json.loads(t, object_pairs_hook=_hidden), separators=(",", ":"))
        except ValueError:
            return t

    return texts.map(one)


def month_start(day: Column, offset: int = 0) -> Column:
    return F.add_months(F.trunc(day, "MM"), offset)


PASSWORD_CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")


def password_report(password: Column, username: Column | None = None, common: list[str] | None = None, least: int = 12, most: int = 128, classes: int = 3) -> Column:
    """All rules that a password breaks: its length, the classes of characters in it (lower, upper, digit, symbol), a common
    password (also once what isn't a letter is cut off its ends), the username in it (of three characters or more)."""
    lower = F.lower(password)
    has = sum((password.rlike(c).cast("int") for c in PASSWORD_CLASSES), F.lit(0))
    bare = F.regexp_extract(lower, "(?s)[a-z](?:.*[a-z])?", 0)  # from its first letter to its last
    known = (lower.isin(common) | bare.isin([c for c in common if c])) if common else F.lit(False)
    rules = [("TOO_SHORT", F.length(password) < least), ("TOO_LONG", F.length(password) > most), ("INSUFFICIENT_CHARACTER_CLASSES", has < classes), ("COMMON_PASSWORD", known)]
    if username is not None:
        rules.append(("CONTAINS_USERNAME", (F.length(username) >= 3) & F.contains(lower, F.lower(username))))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def backoff_seconds(attempt: Column) -> Column:
    """The base of the retry delay; callers spread it by a random factor of 0.5 to 1.5."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(300.0))
