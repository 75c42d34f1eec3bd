"""Dense and sparse vectors. Cosine is a plain dot product: vectors are normalised when they are written."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 for empty vectors; vectors of different lengths are an error."""
    same = F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("vectors of different lengths")))
    return F.aggregate(F.zip_with(same, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Of length 1; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def hash_embedding(dim: int = 128):
    """A pandas UDF: counts of lower-cased ASCII tokens in buckets of an 8-byte BLAKE2b, normalised."""
    token = re.compile(r"[a-z0-9_\-]+")

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        def one(text):
            v = np.zeros(dim)
            for w, n in Counter(token.findall((text or "").lower())).items():
                v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % dim] += n
            size = np.sqrt((v * v).sum())
            return v / (size or 1.0)

        return s.map(one)

    return embed


def _sparse_tokens(text: str):
    return re.findall(r"[^\W_]+", text.casefold())


def hash_sparse():
    """A pandas UDF: token counts by a 4-byte BLAKE2b, as (indices ascending, values)."""

    @F.pandas_udf("indices array<bigint>, values array<double>")
    def encode(s: pd.Series) -> pd.DataFrame:
        rows = []
        for text in s:
            c: Counter = Counter()
            for w, n in Counter(_sparse_tokens(text or "")).items():
                c[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big")] += n
            at = sorted(c)
            rows.append((at, [float(c[i]) for i in at]))
        return pd.DataFrame(rows, columns=["indices", "values"])

    return encode


def uuid5(name: Column, namespace: uuid.UUID) -> Column:
    """The UUID of a name in a namespace: SHA-1 of both, with version and variant bits."""
    h = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    variant = F.substring(variant, -1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


#: The namespace of point ids of this engine.
POINTS = uuid.UUID("7f0f6c55-6d1c-5b0e-9b6e-3d2f52d0a1c4")


def point_id(stored: Column, chunk_id: Column) -> Column:
    """A stored id that is a number or a UUID (in canonical form), else one made from the chunk's id."""
    raw = F.trim(stored)
    bare = F.lower(F.regexp_replace(raw, "^urn:uuid:|[{}-]", ""))
    dashed = F.concat_ws("-", *[F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(raw.rlike("^[0-9]+$"), raw).when(bare.rlike("^[0-9a-f]{32}$"), dashed).otherwise(uuid5(chunk_id.cast("string"), POINTS))
