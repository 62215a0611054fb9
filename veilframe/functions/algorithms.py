"""Ciphers, hashes and LIKE shadows by name, as Column expressions and, for literals, as Python functions.

Native expressions are used wherever Spark has them (SHA-256, AES, masks); SM3 and SM4 run as Arrow-batched UDFs. A literal of a
statement is transformed once on the driver, so that comparisons reach the scan as constants.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.errors import misconfigured
from veilframe.functions import masks


@dataclass(frozen=True)
class Cipher:
    encrypt: Callable[[Column], Column]
    decrypt: Callable[[Column], Column]
    #: Null where a value does not decrypt, for comparisons.
    try_decrypt: Callable[[Column], Column]


@dataclass(frozen=True)
class Transform:
    column: Callable[[Column], Column]
    value: Callable[[str], str] | None = None


def material(key: str) -> str:
    if not key or not key.strip():
        raise misconfigured("INVALID_FIELD_RULE", "blank key")
    return key


def aes(key: str) -> Cipher:
    """AES-GCM under the first 16 bytes of the key's SHA-256; Base64 of nonce, ciphertext and tag."""
    own = hashlib.sha256(material(key).encode()).hexdigest()[:32]
    secret = lambda: F.unhex(F.lit(own))
    text = lambda c: F.decode(c, "UTF-8")
    return Cipher(
        lambda c: F.base64(F.aes_encrypt(F.encode(c, "UTF-8"), secret(), F.lit("GCM"))),
        lambda c: text(F.aes_decrypt(F.unbase64(c), secret(), F.lit("GCM"))),
        lambda c: text(F.try_aes_decrypt(F.when(c.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (F.length(c) >= 40), F.unbase64(c)), secret(), F.lit("GCM"))),
    )


def sm4(key: str) -> Cipher:
    """SM4-GCM under the first 16 bytes of the key's SM3; the same layout."""
    secret = hashlib.new("sm3", material(key).encode()).digest()[:16]

    def encrypt(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from veilframe.functions.sm4 import Gcm

        gcm = Gcm(secret)
        for s in parts:
            there = s.notna()
            sealed = gcm.seal([os.urandom(12) for _ in range(int(there.sum()))], [v.encode() for v in s[there]])
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[there] = [base64.b64encode(x).decode() for x in sealed]
            yield out

    def opened(strict: bool) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
        def decrypt(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from veilframe.functions.sm4 import Gcm

            gcm = Gcm(secret)

            def raw(v: str) -> bytes:
                try:
                    return base64.b64decode(v, validate=True)
                except ValueError:
                    return b""

            for s in parts:
                there = s.notna()
                plain = gcm.open([raw(v) for v in s[there]])
                if strict and any(p is None for p in plain):
                    raise ValueError("CIPHER_OPERATION_FAILED: a value does not decrypt")
                out = pd.Series([None] * len(s), index=s.index, dtype=object)
                out[there] = [None if p is None else p.decode() for p in plain]
                yield out

        return decrypt

    def udf(f: Any) -> Callable[[Column], Column]:
        return F.pandas_udf(f, "string", F.PandasUDFType.SCALAR_ITER)

    sealed = udf(encrypt).asNondeterministic()  # evaluated once per row, never duplicated by the optimiser
    return Cipher(sealed, udf(opened(True)), udf(opened(False)))


def sha256() -> Transform:
    return Transform(lambda c: F.sha2(c, 256), lambda v: hashlib.sha256(v.encode()).hexdigest())


def sm3(salt_hex: str = "") -> Transform:
    """Lower-case hex of SM3 over the salt and the value."""
    salt = bytes.fromhex(salt_hex)

    def digest(s: pd.Series) -> pd.Series:
        base = hashlib.new("sm3", salt)

        def one(v: str | None) -> str | None:
            if v is None:
                return None
            h = base.copy()
            h.update(v.encode())
            return h.hexdigest()

        return s.astype(object).where(s.notna(), None).map(one, na_action="ignore")

    return Transform(F.pandas_udf(digest, "string", F.PandasUDFType.SCALAR), lambda v: hashlib.new("sm3", salt + v.encode()).hexdigest())


@dataclass
class Algorithms:
    """Three registries: ciphers, hashes and LIKE shadows or masks."""

    ciphers: dict[str, Cipher] = field(default_factory=dict)
    hashes: dict[str, Transform] = field(default_factory=dict)
    likes: dict[str, Transform] = field(default_factory=dict)

    @classmethod
    def standard(cls, keys: dict[str, str] | None = None, sm3_salt: str = "") -> Algorithms:
        """``keys`` of "aes" and "sm4"; a cipher without a key isn't there, and a rule that names it is refused."""
        keys = keys or {}
        tail4 = (masks.keep_first_last(0, 4), masks.value_keep(0, 4))
        likes = {"normalizedLike": (masks.normalized_like, masks.value_normalized), "idCardMaskLike": (masks.keep_first_last(3, 3), masks.value_keep(3, 3)), "phoneMaskLike": tail4, "bankCardMaskLike": tail4, "nameMaskLike": (masks.name_mask, masks.value_name)}
        return cls({name: make(keys[name]) for name, make in (("aes", aes), ("sm4", sm4)) if keys.get(name)}, {"sha256": sha256(), "sm3": sm3(sm3_salt)}, {k: Transform(*f) for k, f in likes.items()})

    def cipher(self, name: str) -> Cipher:
        if name not in self.ciphers:
            raise misconfigured("MISSING_CIPHER_ALGORITHM", name)
        return self.ciphers[name]

    def hash(self, name: str) -> Transform:
        if name not in self.hashes:
            raise misconfigured("MISSING_ASSISTED_QUERY_ALGORITHM", name)
        return self.hashes[name]

    def like(self, name: str) -> Transform:
        if name not in self.likes:
            raise misconfigured("MISSING_LIKE_QUERY_ALGORITHM", name)
        return self.likes[name]

    def hash_value(self, name: str, value: Any) -> str | None:
        return None if value is None else self.hash(name).value(str(value))

    def like_value(self, name: str, value: Any) -> str | None:
        """A LIKE operand in shadow form; algorithms without a Python form are asked through Spark once."""
        if value is None:
            return None
        own = self.like(name)
        if own.value is not None:
            return own.value(str(value))
        from pyspark.sql import SparkSession

        return SparkSession.active().range(1).select(own.column(F.lit(str(value)))).first()[0]
