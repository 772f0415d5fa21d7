import base64
import hashlib
import hmac
import json
import re

import pytest
from gatewatch import catalogs
from gatewatch.functions import scalars as s
from gatewatch.functions.regex import to_java
from pyspark.sql import functions as F

CASES = [
    (r"\.env(\b|_)", "i", ["/.env", "/.ENV_x", "/.envx", "/.enveé", "/.env\n"]),
    (r"a$", "", ["a", "a\n", "ba"]),
    (r"caf\b", "", ["caf", "café", "caf-"]),
    (r"x\sy[\s]z", "", ["x y z", "x y z", "xyz"]),
    (r"q.r", "", ["qxr", "q\nr", "q\x85r", "q r"]),
    (r"universit[eä]t", "i", ["UNIVERSITÄT", "universitet", "Universit"]),
    (r"[[&&]x", "", ["[x", "&x", "x"]),
    (r"('|\")\s*OR", "i", ["' or", '"OR', "or"]),
]


@pytest.mark.parametrize(("pattern", "flags", "texts"), CASES)
def test_translated_patterns(spark, pattern, flags, texts):
    js = re.compile(pattern.replace("$", r"\Z").replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))").replace("[[&&]", r"[\[&]").replace("q.r", "q[^\\n\\r\\u2028\\u2029]r"), re.I if flags else 0)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in df.select(F.col("t").rlike(to_java(pattern, bool(flags))).alias("m")).collect()]
    assert got == [bool(js.search(t)) for t in texts]


def test_catalog_against_python(spark):
    """Every pattern of the catalog, on texts made from the patterns themselves, as an independent engine has it."""
    catalog = catalogs.load()
    assert (len(catalog.methods), len(catalog.bodies), len(catalog.paths), len(catalog.tools), len(catalog.bots), len(catalog.asn_types)) == (5, 39, 277, 3, 81, 237)
    patterns = catalog.paths + catalog.bodies + catalog.tools + catalog.bots
    texts = sorted({re.sub(r"\\([./])", r"\1", re.sub(r"\(\?:|[()^$?+*]|\\b|\\s|\\d|\\w", "", p.pattern)).split("|")[0] for p in patterns} | {"/", "/favicon.ico", "", "/.env", "/a?q=1 UNION SELECT 2"})
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(2)
    flags = lambda p: re.A | (re.I if p.ignore_case else 0)
    ours = re.compile
    for at in range(0, len(patterns), 100):
        part = patterns[at : at + 100]
        rows = df.select("t", *[F.col("t").rlike(to_java(p.pattern, p.ignore_case)).alias(f"p{k}") for k, p in enumerate(part)]).collect()
        for k, p in enumerate(part):
            rx = ours(p.pattern.replace("$", r"\Z") if p.pattern.endswith("$") or "|$)" in p.pattern or "?$" in p.pattern else p.pattern, flags(p))
            assert [r[f"p{k}"] for r in rows] == [bool(rx.search(r.t)) for r in rows], p.pattern


def test_small_functions(spark):
    df = spark.createDataFrame([("34.150.99.95", ["/a", "/b"], ["/b", "/a"]), ("2001:db8::1", [], []), ("1.2.3", ["/a"], ["/c"]), (None, ["/a", "/b"], ["/b"])], "ip string, a array<string>, b array<string>")
    rows = df.select(s.subnet24(F.col("ip")).alias("n"), s.jaccard(F.col("a"), F.col("b")).alias("j"), s.route_fingerprint(F.col("a")).alias("x"), s.route_fingerprint(F.col("b")).alias("y"), s.is_valid_ip(F.col("ip")).alias("v")).collect()
    assert [r.n for r in rows] == ["34.150.99.0/24", None, None, None] and [r.j for r in rows] == [1.0, 0.0, 0.0, 0.5]
    assert rows[0].x == rows[0].y == hashlib.sha1(b"/a\n/b").hexdigest() and [r.v for r in rows] == [True, True, True, False]
    bands = spark.createDataFrame([(0.75,), (0.55,), (0.4,), (0.399,)], "c double").select(s.threat_band(F.col("c")).alias("b")).collect()
    assert [r.b for r in bands] == ["high", "medium", "low", "none"]


def test_sources(spark):
    agents = {None: "no-agent", "": "no-agent", "curl/8": "curl", "PostmanRuntime/7": "postman", "insomnia/1": "insomnia", "Googlebot/2": "bot", "Mozilla/5.0": "bot", "Mozilla/5.0 (X11) Firefox/120.0": "browser", "what": "unknown"}
    df = spark.createDataFrame([(a,) for a in agents], "ua string")
    assert {r.ua: r.s for r in df.select("ua", s.source_of(F.col("ua"), catalogs.load()).alias("s")).collect()} == agents


def test_forwarding_chain(spark):
    rows = [(None, None, None), ("1.1.1.1", None, None), ("1.1.1.1, 2.2.2.2", None, None), (" 9.9.9.9 ,, 1.1.1.1,2.2.2.2", None, None), (None, "3.3.3.3", ""), ("", "", "US")]
    df = spark.createDataFrame(rows, "x string, c string, n string")
    got = [r.f for r in df.select(s.forwarding_chain(F.col("x"), F.col("c"), F.col("n")).alias("f")).collect()]
    assert got[0] is None and got[1] is None
    assert (got[2].chain, got[2].spoofed) == (["1.1.1.1", "2.2.2.2"], None)
    assert (got[3].chain, got[3].spoofed, got[3].claimed_ip) == (["9.9.9.9", "1.1.1.1", "2.2.2.2"], True, "9.9.9.9")
    assert (got[4].chain, got[4].cf_connecting_ip, got[4].cf_ip_country) == (None, "3.3.3.3", None) and got[5].cf_ip_country == "US"


def test_redaction_and_tokens(spark):
    body = '{"user":"a","Password":"p","deep":[{"api_token":{"x":1},"n":2}],"t":null}'
    df = spark.createDataFrame([(body,), (None,), ("not json",), ('"text"',), ("[]",)], "b string")
    got = [r.r for r in df.select(s.redacted(F.col("b")).alias("r")).collect()]
    assert got == ['{"user":"a","Password":"[REDACTED]","deep":[{"api_token":"[REDACTED]","n":2}],"t":null}', None, "not json", '"text"', "[]"]
    same = ['{"n": 1e5, "n": 2}', "[" * 3]
    hidden = ['{"a":{"token":1},"a":2}', '{"\\u0074oken":1}', '{"a":' * 100_000]
    odd = spark.createDataFrame([(k, b) for k, b in enumerate(same + hidden)], "k int, b string").orderBy("k")
    assert [r.r for r in odd.select(s.redacted(F.col("b")).alias("r")).collect()] == [*same, '{"a":{"token":"[REDACTED]"},"a":2}', '{"\\u0074oken":"[REDACTED]"}', '"[REDACTED]"']
    kept = ['1e400', '1E5', '-0.10000000000000000000000001', '123456789012345678901234567890', '"\\u00e9\\/ \\" : {"', 'true', '[1.50,{"a":[]},{}]', '9' * 5_000]
    around = [(k, '{ "x" : ' + v + ', "Secret":[{"a":[1,"]"]},2] ,"x":' + v + ' }') for k, v in enumerate(kept)]
    got = spark.createDataFrame(around, "k int, b string").orderBy("k").select(s.redacted(F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == ['{"x":' + v + ',"Secret":"[REDACTED]","x":' + v + '}' for v in kept]
    no_json = ['{"token":1', '{"token":NaN}', '{"token":1}}']
    assert [r.r for r in spark.createDataFrame([(b,) for b in no_json], "b string").select(s.redacted(F.col("b")).alias("r")).collect()] == no_json
    code = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()

    def token(claims, key=b"k"):
        text = f"{code(json.dumps({'alg': 'HS256'}).encode())}.{code(json.dumps(claims).encode())}"
        return f"{text}.{code(hmac.new(key, text.encode(), hashlib.sha256).digest())}"

    tokens = [token({"user_id": 7, "sessionId": "s"}), token({"userId": 8}), token({"user_id": 7}, b"x"), "a.b", None, token({"user_id": 1, "exp": 5})]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select(s.token_claims(F.col("t"), "k").alias("c")).collect()
    assert [(r.c.user_id, r.c.session_id) for r in rows] == [(7, "s"), (8, None), (None, None), (None, None), (None, None), (None, None)]
