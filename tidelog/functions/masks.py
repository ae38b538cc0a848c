"""Masking strategies [P1-P7, P17]. Absent and NULL values are left alone; everything is a built-in expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
STRATEGIES = ("redact", "null", "sha256", "hmac256", "last4")
_BLOCK = 64


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of the text; the padded keys are literals, so the whole stays in generated code."""
    if len(key) > _BLOCK:
        import hashlib

        key = hashlib.sha256(key).digest()
    padded = key.ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in padded)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def last4(value: Column) -> Column:
    """Stars but for the last four characters; four or fewer are all stars."""
    n = F.char_length(value)
    return F.when(n <= 4, F.lit("****")).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.substring(value, -4, 4)))


def mask(strategy: str, key: bytes = b"") -> Callable[[Column], Column]:
    """The strategy as a function on string columns; an unknown name, or hmac256 without a key, is an error now."""
    if strategy == "hmac256" and not key:
        raise ValueError("mask strategy hmac256 needs a key")
    made = {
        "redact": lambda v: F.lit(REDACTED),
        "null": lambda v: F.lit(None).cast("string"),
        "sha256": sha256,
        "hmac256": lambda v: hmac_sha256(v, key),
        "last4": last4,
    }.get(strategy)
    if made is None:
        raise ValueError(f"unknown mask strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return lambda v: F.when(v.isNotNull(), made(v))


def mask_map(data: Column, strategies: dict[str, str], key: bytes = b"") -> Column:
    """Mask entries of a map<string,string>; keys stay, also where the value becomes null."""
    chosen = {name: mask(s, key) for name, s in strategies.items()}
    if not chosen:
        return data

    def one(k: Column, v: Column) -> Column:
        out = v
        for name, f in chosen.items():
            out = F.when(k == name, f(v)).otherwise(out)
        return out

    return F.transform_values(data, one)


def drop_keys(data: Column, names: list[str]) -> Column:
    """The map without some columns."""
    return F.map_filter(data, lambda k, _: ~k.isin(*names)) if names else data


def signature(body: Column, timestamp: Column, secret: bytes) -> Column:
    """Request signature: sha256= and the hex HMAC over "<timestamp>.<body>"."""
    return F.concat(F.lit("sha256="), hmac_sha256(F.concat_ws(".", timestamp, body), secret))
