"""Data checks as expressions: links that carry credentials, number ranges, key and constraint violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of query parameters and attributes that hold secrets (hyphens and dots read as underscores), and endings
#: of such names.
SECRET_NAMES = (
    "access_token", "api_key", "apikey", "auth", "authorization", "bearer", "client_secret", "credential", "credentials", "password", "passwd", "secret", "signature", "token",
    "x_api_key", "x_amz_credential", "x_amz_security_token", "x_amz_signature",
)
SECRET_ENDINGS = ("_token", "_secret", "_password", "_api_key")
UINT32, UINT64 = 2**32 - 1, 2**64 - 1


def secret_name(name: Column) -> Column:
    n = F.translate(F.lower(F.trim(name)), "-.", "__")
    out = n.isin(*SECRET_NAMES)
    for e in SECRET_ENDINGS:
        out = out | F.endswith(n, F.lit(e))
    return out


def bearer_value(value: Column) -> Column:
    return F.startswith(F.lower(F.ltrim(value)), F.lit("bearer "))


def link_credentials(url: Column) -> Column:
    """Why a link isn't safe to store: user info, a secret parameter, a bearer value; null if it is."""
    info = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)@", 1)
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    secret = F.exists(pairs, lambda x: F.contains(x, F.lit("=")) & secret_name(plain(F.substring_index(x, "=", 1))))
    bearer = F.exists(pairs, lambda x: F.contains(x, F.lit("=")) & bearer_value(plain(F.regexp_extract(x, "=(.*)$", 1))))
    return F.when(info != "", "LINK_USERINFO").when(secret, "LINK_SECRET_PARAMETER").when(bearer, "LINK_BEARER_VALUE")


def in_range(c: Column, high: int, low: int = 0) -> Column:
    return F.coalesce(c.cast("decimal(20,0)").between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)")), F.lit(False))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: one row for each rule that a row breaks; a rule that is null isn't broken."""
    broken = F.array_compact(F.array(*[F.when(~c, name) for name, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def missing_parents(child: DataFrame, parent: DataFrame, on: str, ref: str) -> DataFrame:
    return child.where(F.col(on).isNotNull()).join(parent.select(F.col(ref).alias(on)).distinct(), on, "left_anti")
