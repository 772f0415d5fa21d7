"""Classification of requests: which threat patterns they match, and how severe that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogs import Catalog, Pattern, load
from ..functions.literals import mask_of, to_try
from ..functions.regex import any_of, to_java
from ..functions.scalars import is_valid_ip, level_of, rank_of
from ..tables import per_distinct

SIGNAL = "struct<category:string,severity:string,description:string,matched:string,raw_xff:string,tier:string,count:int,limit:int>"
SIGNALS = f"array<{SIGNAL}>"
#: Patterns in one array expression; longer ones outgrow the JVM's limit on generated methods.
_CHUNK = 40
#: Columns that only classification itself reads.
_PARTS = ("path_signals", "url_signals", "url_rank", "method_signals", "line_signals", "method_rank", "body_signals")


def signal(category: str, severity: str | Column, description: str | Column, matched: Column | None = None, **more: Column) -> Column:
    null = F.lit(None)
    fixed = lambda c: c if isinstance(c, Column) else F.lit(c)
    text = lambda c: (null if c is None else c).cast("string")
    number = lambda c: (null if c is None else c).cast("int")
    return F.struct(
        F.lit(category).alias("category"), fixed(severity).alias("severity"), fixed(description).alias("description"),
        text(matched).alias("matched"), text(more.get("raw_xff")).alias("raw_xff"), text(more.get("tier")).alias("tier"),
        number(more.get("count")).alias("count"), number(more.get("limit")).alias("limit"),
    )


def no_signals() -> Column:
    return F.array().cast(SIGNALS)


def _raw(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _names(values: list[str]) -> str:
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def screened(rows: DataFrame, text: str, patterns: tuple[Pattern, ...], mask: str) -> DataFrame:
    """``rows`` with the column ``mask``, which tells :func:`scan` what patterns are worth trying on each text."""
    return rows.withColumn(mask, mask_of(F.col(text), [p.pattern for p in patterns]))


def scan(text: str, patterns: tuple[Pattern, ...], category: str, with_match: bool = False, mask: str | None = None) -> Column:
    """Signals of all patterns that the column ``text`` matches, in the catalog's order.

    Each pattern is tested as a literal (compiled once) and the numbers of those that match pick their
    descriptions. Where there is a ``mask`` (see :func:`screened`), patterns without their literals in the text
    are not tried; else one alternation comes first, so that text without any match costs a single pass.
    """
    chunks = []
    for at in range(0, len(patterns), _CHUNK):
        numbered = enumerate(patterns[at : at + _CHUNK], at)
        tests = [(f"{to_try(mask, k)} AND " if mask else "") + f"{text} RLIKE {_raw(to_java(p.pattern, p.ignore_case))}" for k, p in numbered]
        chunks.append(f"filter(array({', '.join(f'IF({t}, {at + k + 1}, NULL)' for k, t in enumerate(tests))}), n -> n IS NOT NULL)")
    severity, description = _names([p.severity for p in patterns]), _names([p.description for p in patterns])
    matched = text if with_match else "CAST(NULL AS STRING)"
    made = f"named_struct('category', '{category}', 'severity', element_at({severity}, n), 'description', element_at({description}, n), 'matched', {matched}, 'raw_xff', CAST(NULL AS STRING), 'tier', CAST(NULL AS STRING), 'count', CAST(NULL AS INT), 'limit', CAST(NULL AS INT))"
    any_hit = f"exists(`{mask}`, w -> w <> 0)" if mask else f"{text} RLIKE {_raw(any_of(patterns))}"
    return F.expr(f"IF({any_hit}, transform(concat({', '.join(chunks)}), n -> {made}), CAST(array() AS {SIGNALS}))")


def url_signals(urls: DataFrame, catalog: Catalog) -> DataFrame:
    """``path_signals``, ``url_signals``, ``is_attack``, ``path_rank`` and ``url_rank`` (of both) of each row's ``full_url``."""
    found = urls.withColumns({"path_signals": scan("full_url", catalog.paths, "path", True), "url_signals": scan("full_url", catalog.bodies, "url")})
    path = top_rank(F.col("path_signals"))
    return found.withColumns({"is_attack": F.size("path_signals") > 0, "path_rank": path, "url_rank": F.greatest(path, top_rank(F.col("url_signals")))})


def method_signals(methods: DataFrame, catalog: Catalog) -> DataFrame:
    """``method_signals`` (exact names), ``line_signals`` (body patterns in a malformed method) and ``method_rank`` (of both)."""
    method = F.col("method")
    exact = F.filter(F.array(*[F.when(method == p.pattern, signal("method", p.severity, p.description, method)) for p in catalog.methods]), lambda x: x.isNotNull())
    found = methods.withColumns({"method_signals": exact.cast(SIGNALS), "line_signals": scan("method", catalog.bodies, "method")})
    return found.withColumn("method_rank", F.greatest(top_rank(F.col("method_signals")), top_rank(F.col("line_signals"))))


def body_signals(rows: DataFrame, catalog: Catalog) -> Column:
    """Signals of ``request_body`` where it is a JSON object or list that is not empty; none without the column."""
    if "request_body" not in rows.columns:
        return no_signals()
    text = F.trim("request_body")
    is_object = text.rlike(r"^[\[{]") & ~text.isin("{}", "[]")
    return F.when(F.coalesce(is_object, F.lit(False)), scan("request_body", catalog.bodies, "body")).otherwise(no_signals())


def top_rank(signals: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(signals, lambda s: rank_of(s["severity"]))), F.lit(0))


def classify(requests: DataFrame, catalog: Catalog | None = None, body_is_object: bool = True) -> DataFrame:
    """``requests`` with ``threat_level``, ``threat_rank``, ``threat_details``, ``is_attack`` and ``path_rank``.

    Needs ``full_url, method, user_agent``; a JSON text in ``request_body`` is scanned too unless bodies are
    stored as strings (``body_is_object`` false). Patterns run once per distinct URL and method. Details are
    null, not empty, at level none. A null URL or method matches nothing; columns of these names are replaced.
    """
    catalog = catalog or load()
    made = ["threat_level", "threat_rank", "threat_details", "is_attack", "path_rank", *_PARTS]
    rows = requests.drop(*made)
    rows = per_distinct(rows, "full_url", lambda u: url_signals(u, catalog))
    rows = per_distinct(rows, "method", lambda m: method_signals(m, catalog))
    return leveled(rows, catalog, body_is_object)


def leveled(rows: DataFrame, catalog: Catalog, body_is_object: bool = True) -> DataFrame:
    """Level and details of rows that have the signals and ranks of their URL and method, which go.

    The rank comes from the parts' ranks, so that queries that do not show details do not make them; bodies of
    requests that are at the highest rank already are read for the details alone.
    """
    no_agent = F.coalesce("user_agent", F.lit("")) == ""
    agent = F.when(no_agent, F.array(signal("agent", "low", "no user agent")).cast(SIGNALS)).otherwise(no_signals())
    rows = rows.withColumn("body_signals", body_signals(rows, catalog) if body_is_object else no_signals())
    known = F.greatest("url_rank", "method_rank", F.when(no_agent, rank_of(F.lit("low"))).otherwise(0))
    rows = rows.withColumns({
        "threat_rank": F.when(known == rank_of(F.lit("high")), known).otherwise(F.greatest(known, top_rank(F.col("body_signals")))),
        "threat_details": F.concat("path_signals", "method_signals", "body_signals", "url_signals", "line_signals", agent),
    })
    rows = rows.withColumns({"threat_level": level_of(F.col("threat_rank")), "threat_details": F.when(F.size("threat_details") > 0, F.col("threat_details"))})
    return rows.drop(*_PARTS)


def _with_signal(rows: DataFrame, when: Column, added: Column, rank: Column) -> DataFrame:
    details = F.concat(F.coalesce("threat_details", no_signals()), F.array(added).cast(SIGNALS))
    rows = rows.withColumns({"threat_details": F.when(when, details).otherwise(F.col("threat_details")), "threat_rank": F.when(when, F.greatest("threat_rank", rank)).otherwise(F.col("threat_rank"))})
    return rows.withColumn("threat_level", level_of(F.col("threat_rank")))


def check_addresses(rows: DataFrame) -> DataFrame:
    """An address with characters that no address has becomes 0.0.0.0, at level high, with a signal.

    ``x_forwarded_for``, if there, is what the signal shows. No address is 0.0.0.0 as well, without a signal.
    """
    header = F.col("x_forwarded_for") if "x_forwarded_for" in rows.columns else F.lit(None)
    rows = rows.withColumn("ip", F.when(F.coalesce("ip", F.lit("")) == "", "0.0.0.0").otherwise(F.col("ip")))
    rows = _with_signal(rows.withColumn("__bad", ~is_valid_ip(F.col("ip"))), F.col("__bad"), signal("ip", "high", "IP spoof via X-Forwarded-For", raw_xff=header), F.lit(3))
    return rows.withColumn("ip", F.when(F.col("__bad"), "0.0.0.0").otherwise(F.col("ip"))).drop("__bad")


def add_rate_limits(rows: DataFrame) -> DataFrame:
    """A signal for rows whose ``rate_tier`` is set (with ``rate_severity, rate_count, rate_limit``); may raise the level."""
    described = F.format_string("%s rate limit exceeded (%s/%s)", "rate_tier", F.col("rate_count").cast("string"), F.col("rate_limit").cast("string"))
    added = signal("rate_limit", F.col("rate_severity"), described, tier=F.col("rate_tier"), count=F.col("rate_count"), limit=F.col("rate_limit"))
    return _with_signal(rows, F.col("rate_tier").isNotNull(), added, rank_of(F.col("rate_severity")))


def is_attack_path(route: Column, catalog: Catalog) -> Column:
    return F.coalesce(route.rlike(any_of(catalog.paths)), F.lit(False))


def path_severity(route: Column, catalog: Catalog) -> Column:
    """Greatest severity of the path patterns that match."""
    by = lambda s: any_of([p for p in catalog.paths if p.severity == s]) or r"(?!)"
    return F.when(route.rlike(by("high")), "high").when(route.rlike(by("medium")), "medium").when(route.rlike(by("low")), "low").otherwise("none")
