"""Column functions of requests and scores."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogs import Catalog
from .regex import SPACES, any_of, to_java

#: Words of keys whose values are redacted.
SENSITIVE_KEYS = r"password|token|secret|ssn|credit.?card|authorization"
#: Forwarding hops that are the site's own.
TRUSTED_HOPS = 2


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def is_ipv4(ip: Column) -> Column:
    return ~ip.contains(":")


def subnet24(ip: Column) -> Column:
    """``a.b.c.0/24`` of an address with four parts; null for any other."""
    return F.when(F.size(F.split(ip, r"\.")) == 4, F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def route_fingerprint(routes: Column) -> Column:
    """SHA-1 of the sorted routes, one a line; the order of the array does not matter."""
    return F.sha1(F.concat_ws("\n", F.sort_array(routes)))


def threat_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.55, "medium").when(confidence >= 0.4, "low").otherwise("none")


def rank_of(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)


def level_of(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").when(rank == 1, "low").otherwise("none")


def source_of(user_agent: Column, catalog: Catalog) -> Column:
    """Kind of client; the first rule that holds decides."""
    return (
        F.when(F.coalesce(user_agent, F.lit("")) == "", "no-agent")
        .when(user_agent.rlike("(?i)^curl/"), "curl")
        .when(user_agent.rlike("(?i)postman"), "postman")
        .when(user_agent.rlike("(?i)insomnia"), "insomnia")
        .when(user_agent.rlike(any_of(catalog.bots)), "bot")
        .when(user_agent.rlike("(?i)mozilla|chrome|safari|firefox|edge|opera"), "browser")
        .otherwise("unknown")
    )


def is_exploit_tool(user_agent: Column, catalog: Catalog) -> Column:
    return F.coalesce(user_agent.rlike(any_of(catalog.tools)), F.lit(False))


def is_valid_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(r"^[\d.:a-fA-F]+\z"), F.lit(False))


def ip_type(asn: Column, org: Column, registered: Column, catalog: Catalog) -> Column:
    """``registered`` type of the network, else the first rule on its organisation; null without a network."""
    by_org = F.lit("unknown")
    for kind, pattern in reversed(catalog.org_types):
        by_org = F.when(F.coalesce(org, F.lit("")).rlike(to_java(pattern, True)), kind).otherwise(by_org)
    return F.when(F.coalesce(asn, F.lit(0)) != 0, F.coalesce(registered, by_org))


def forwarding_chain(xff: Column, connecting_ip: Column, country: Column) -> Column:
    """Struct of the proxy chain, or null without edge headers and with fewer than two hops.

    ``spoofed`` is true or null, with the first hop as ``claimed_ip`` when there are more hops than trusted.
    """
    filled = lambda c: F.when(c != "", c)
    chain = F.filter(F.transform(F.split(F.coalesce(xff, F.lit("")), ","), lambda x: F.regexp_replace(x, rf"^[{SPACES}]+|[{SPACES}]+\z", "")), lambda x: x != "")
    edge = F.coalesce(filled(connecting_ip), filled(country)).isNotNull()
    spoofed = F.size(chain) > TRUSTED_HOPS
    return F.when(
        edge | (F.size(chain) >= 2),
        F.struct(
            F.when(F.size(chain) > 0, chain).alias("chain"),
            filled(connecting_ip).alias("cf_connecting_ip"),
            filled(country).alias("cf_ip_country"),
            F.when(spoofed, F.lit(True)).alias("spoofed"),
            F.when(spoofed, F.element_at(chain, 1)).alias("claimed_ip"),
        ),
    )


#: Tokens of JSON text; white space between them is left out.
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')
_OPENS, _CLOSES = ("{", "["), ("}", "]")


def _no_json(name: str):
    raise ValueError(name)


def _without_sensitive(text: str, sensitive: re.Pattern) -> str:
    """``text``, a JSON value, with the values of sensitive keys replaced; all other tokens stay as they are."""
    tokens, out, at = _JSON_TOKEN.findall(text), [], 0
    while at < len(tokens):
        out.append(tokens[at])
        at += 1
        if tokens[at : at + 1] != [":"] or not sensitive.search(json.loads(out[-1])):
            continue
        out += [":", '"[REDACTED]"']
        at, depth = at + 1, 0
        while True:
            depth += (tokens[at] in _OPENS) - (tokens[at] in _CLOSES)
            at += 1
            if not depth:
                break
    return "".join(out)


def redacted(body: Column, keys: str = SENSITIVE_KEYS) -> Column:
    """JSON text with the values of sensitive keys replaced, at any depth.

    Where there is such a key, white space between tokens goes; all other keys and values, repeated keys too,
    keep every character. Text without such a key stays as it is, as does text that is no JSON; JSON too deep to
    read is replaced whole.
    """
    sensitive = re.compile(keys, re.I)

    def one(text):
        found = []
        note = lambda pairs: found.extend(k for k, _ in pairs if sensitive.search(k))
        try:
            json.loads(text, object_pairs_hook=note, parse_int=str, parse_float=str, parse_constant=_no_json)
        except RecursionError:
            return '"[REDACTED]"'
        except ValueError:
            return text
        return _without_sensitive(text, sensitive) if found else text

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return redact(body)


def token_of(cookies: Column, headers: Column, names: tuple[str, ...]) -> Column:
    """The first token by name, in the given order: of a name the cookie, else the header in lower case.

    Both are maps of text, or null. Empty values do not count.
    """
    found = [F.try_element_at(of.cast("map<string,string>"), F.lit(name)) for n in names for of, name in ((cookies, n), (headers, n.lower()))]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def token_claims(token: Column, secret: str) -> Column:
    """Struct ``user_id, session_id`` of an HS256 token; nulls if it is malformed, forged or expired."""

    def part(text: str) -> bytes:
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))

    def one(text):
        try:
            head, body, signature = text.split(".")
            good = hmac.new(secret.encode(), f"{head}.{body}".encode(), hashlib.sha256).digest()
            claims = json.loads(part(body))
            if json.loads(part(head)).get("alg") != "HS256" or not hmac.compare_digest(good, part(signature)) or claims.get("exp", 1e18) < time.time():
                return None, None
            pick = lambda a, b: claims.get(a) if claims.get(a) is not None else claims.get(b)
            user, session = pick("user_id", "userId"), pick("session_id", "sessionId")
            return None if user is None else int(user), None if session is None else str(session)
        except (ValueError, AttributeError, TypeError):
            return None, None

    @F.pandas_udf("user_id long, session_id string")
    def claims_of(tokens: pd.Series) -> pd.DataFrame:
        found = [one(t) for t in tokens]
        return pd.DataFrame({"user_id": pd.array([f[0] for f in found], dtype="Int64"), "session_id": [f[1] for f in found]})

    return claims_of(token)
