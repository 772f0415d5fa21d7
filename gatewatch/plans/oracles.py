"""The queries' results in plain SQL, with the catalog's original pattern texts."""

from __future__ import annotations

from ..catalogs import Catalog, Pattern
from ..operators.epochs import MARKER_MS
from ..operators.mining import ORDINARY_ROUTES
from ..operators.strategies import STRATEGIES
from ..sources.requests import CITIES_SQL, DERIVED_SQL, NETWORKS_SQL
from .settings import FINE_STEP_MS, KNOWN_ASN, MIN_CONFIDENCE, PAGE_ENDS, PROPOSALS, RECENT_ROWS, SIBLING, SINCE_ID, SLIDE_STEP_MS, SLIDE_WINDOW_MS, WINDOW_MS

_RANK = {"low": 1, "medium": 2, "high": 3}
_ZERO = "CAST(0 AS DOUBLE)"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _re(p: Pattern) -> str:
    return _text(("(?i)" if p.ignore_case else "") + p.pattern.replace(r"\/", "/"))


def _table(name: str, patterns: tuple[Pattern, ...]) -> str:
    rows = ", ".join(f"({k}, {_re(p)}, {_text(p.severity)}, {_RANK.get(p.severity, 0)}, {_text(p.description)})" for k, p in enumerate(patterns))
    return f"{name}(ord, pat, sev, rnk, descr) AS (VALUES {rows})"


def sig(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def band(x: str) -> str:
    return f"CASE WHEN {x} >= 0.75 THEN 'high' WHEN {x} >= 0.55 THEN 'medium' WHEN {x} >= 0.4 THEN 'low' ELSE 'none' END"


def level(x: str) -> str:
    return f"CASE {x} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END"


def subnet(ip: str) -> str:
    return f"CASE WHEN len(string_split({ip}, '.')) = 4 THEN array_to_string(string_split({ip}, '.')[1:3], '.') || '.0/24' END"


def samples(rows: str, value: str, most: int | None = None) -> str:
    """An aggregate of a group's distinct values by the smallest id that has them, as one text."""
    pairs = f"list_sort(list((id, CAST({value} AS VARCHAR))) FILTER ({value} IS NOT NULL))"
    # the first pair of each value: a value is kept where no earlier pair has it
    firsts = f"list_filter({pairs}, lambda p, i: list_position(list_transform({pairs}, lambda q: q[2]), p[2]) = i)"
    cut = f"[1:{most}]" if most else ""
    return f"coalesce(array_to_string(list_transform({firsts}, lambda p: p[2]){cut}, '|'), '')"


def key_bits(ip: str) -> str:
    """The 128 bits of an address as text. IPv6 in any form without an IPv4 tail."""
    side = lambda k: f"list_filter(string_split(coalesce(string_split(lower({ip}), '::')[{k}], ''), ':'), lambda g: g <> '')"
    fill = f"list_transform(range(8 - len({side(1)}) - len({side(2)})), lambda i: '0')"
    v6 = f"array_to_string(list_transform(list_concat({side(1)}, {fill}, {side(2)}), lambda g: lpad(g, 4, '0')), '')"
    v4 = f"repeat('0', 20) || 'ffff' || array_to_string(list_transform(string_split({ip}, '.'), lambda p: lpad(lower(to_hex(CAST(p AS INT))), 2, '0')), '')"
    digits = f"CASE WHEN contains({ip}, ':') THEN {v6} ELSE {v4} END"
    return f"array_to_string(list_transform(string_split({digits}, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '')"


def located(name: str, table: str, values: list[str]) -> str:
    """Two relations: the networks of ``table`` with their bits, and for each address the values of the narrowest."""
    listed = ", ".join(values)
    length = "CASE WHEN contains(network, '/') THEN CAST(split_part(network, '/', 2) AS INT) WHEN contains(network, ':') THEN 128 ELSE 32 END"
    return f"""{name}_nets AS (
  SELECT {listed}, {key_bits("split_part(network, '/', 1)")} AS bits, {length} + CASE WHEN contains(network, ':') THEN 0 ELSE 96 END AS n
  FROM ({table.replace("{events}", "events")})
), {name} AS (
  SELECT a.ip, {listed}
  FROM addresses a JOIN {name}_nets t ON left(a.bits, t.n) = left(t.bits, t.n)
  QUALIFY row_number() OVER (PARTITION BY a.ip ORDER BY t.n DESC, {listed}) = 1
)"""


class Oracles:
    def __init__(self, catalog: Catalog):
        self.c = catalog
        methods = ", ".join(f"({k}, {_text(p.pattern)}, {_text(p.severity)}, {_RANK[p.severity]}, {_text(p.description)})" for k, p in enumerate(catalog.methods))
        self.req = f"req AS (SELECT *, full_url AS route FROM ({DERIVED_SQL.replace('{events}', 'events')}))"
        self.cls = ",\n".join([
            self.req, _table("path_p", catalog.paths), _table("body_p", catalog.bodies), f"method_p(ord, name, sev, rnk, descr) AS (VALUES {methods})",
            "urls AS (SELECT DISTINCT full_url FROM req)", "meths AS (SELECT DISTINCT method FROM req)",
            "path_hits AS (SELECT full_url, ord, sev, rnk, descr FROM urls JOIN path_p ON regexp_matches(full_url, pat))",
            "url_hits AS (SELECT full_url, ord, sev, rnk, descr FROM urls JOIN body_p ON regexp_matches(full_url, pat))",
            "method_hits AS (SELECT method, ord, sev, rnk, descr, true AS exact FROM meths JOIN method_p ON method = name UNION ALL SELECT method, ord, sev, rnk, descr, false FROM meths JOIN body_p ON regexp_matches(method, pat))",
            "bodies AS (SELECT DISTINCT request_body FROM req WHERE regexp_matches(trim(request_body), '^[\\[{]') AND trim(request_body) NOT IN ('{}', '[]'))",
            "body_hits AS (SELECT request_body, ord, sev, rnk, descr FROM bodies JOIN body_p ON regexp_matches(request_body, pat))",
            "body_rank AS (SELECT request_body, max(rnk) AS rnk FROM body_hits GROUP BY request_body)",
            "url_rank AS (SELECT full_url, max(rnk) AS rnk FROM (SELECT full_url, rnk FROM path_hits UNION ALL SELECT full_url, rnk FROM url_hits) GROUP BY full_url)",
            "path_rank AS (SELECT full_url, max(rnk) AS rnk FROM path_hits GROUP BY full_url)", "method_rank AS (SELECT method, max(rnk) AS rnk FROM method_hits GROUP BY method)",
            "cls AS (SELECT req.*, epoch_us(created_at) // 1000 AS ms, coalesce(p.rnk, 0) AS path_rank, p.rnk IS NOT NULL AS is_attack,"
            " greatest(coalesce(u.rnk, 0), coalesce(m.rnk, 0), coalesce(b.rnk, 0), CASE WHEN coalesce(user_agent, '') = '' THEN 1 ELSE 0 END) AS threat_rank"
            " FROM req LEFT JOIN url_rank u USING (full_url) LEFT JOIN path_rank p USING (full_url) LEFT JOIN method_rank m USING (method) LEFT JOIN body_rank b USING (request_body))",
        ])
        self.v4 = self.cls + ",\nv4 AS (SELECT *, min(ms) OVER () AS from_ms, max(ms) OVER () + 1 AS to_ms FROM cls WHERE NOT contains(ip, ':'))"
        self.ep = self.v4 + f",\ne AS (SELECT *, CAST((ms - from_ms) // {WINDOW_MS} AS INT) AS epoch, least(from_ms + ((ms - from_ms) // {WINDOW_MS} + 1) * {WINDOW_MS}, to_ms) AS end_ms, {subnet('ip')} AS subnet FROM v4)"
        self.metrics = self.ep + f""",
per_ip AS (SELECT epoch, ip, count(*) AS volume, count(DISTINCT route) AS unique_paths,
  CASE WHEN count(*) < 2 THEN CAST('inf' AS DOUBLE) ELSE (max(ms) - min(ms)) / 1000.0 END AS burst_sec,
  (count(DISTINCT user_agent) + max(CAST(user_agent IS NULL AS INT))) / CAST(count(*) AS DOUBLE) AS ua_diversity FROM e GROUP BY ALL),
t AS (SELECT * FROM e WHERE threat_rank > 0), nt AS (SELECT * FROM t WHERE NOT coalesce(is_tor, false)),
sets AS (SELECT epoch, asn, subnet, ip, count(DISTINCT CASE WHEN is_attack THEN route END) AS k FROM nt WHERE asn IS NOT NULL GROUP BY ALL),
routes AS (SELECT DISTINCT epoch, asn, subnet, ip, route FROM nt WHERE asn IS NOT NULL AND is_attack),
both_have AS (SELECT a.epoch, a.asn, a.subnet, a.ip, b.ip AS ip2, count(*) AS n FROM routes a JOIN routes b USING (epoch, asn, subnet, route) WHERE a.ip < b.ip GROUP BY ALL),
likeness AS (SELECT h.epoch, h.asn, h.subnet, sum(n / CAST(x.k + y.k - n AS DOUBLE)) AS total FROM both_have h JOIN sets x ON (h.epoch, h.asn, h.subnet, h.ip) = (x.epoch, x.asn, x.subnet, x.ip)
  JOIN sets y ON (h.epoch, h.asn, h.subnet, h.ip2) = (y.epoch, y.asn, y.subnet, y.ip) GROUP BY ALL),
cohesion AS (SELECT epoch, asn, subnet, CASE WHEN n > 1 THEN coalesce(total, 0) / (n * (n - 1) / 2.0) ELSE {_ZERO} END AS cohesion
  FROM (SELECT epoch, asn, subnet, count(*) AS n FROM sets GROUP BY ALL) LEFT JOIN likeness USING (epoch, asn, subnet)),
prints AS (SELECT epoch, asn, ip, sha1(string_agg(DISTINCT route, chr(10) ORDER BY route)) AS fingerprint, count(DISTINCT route) AS n_routes, min((ms, id)) AS first_at FROM t WHERE asn IS NOT NULL GROUP BY ALL),
groups AS (SELECT epoch, asn, fingerprint, count(*) AS ip_count, max(n_routes) AS path_union_size, min(first_at) AS first_at FROM prints WHERE n_routes >= 2 GROUP BY ALL),
dominant AS (SELECT epoch, asn, fingerprint, ip_count, path_union_size FROM groups QUALIFY row_number() OVER (PARTITION BY epoch, asn ORDER BY ip_count DESC, first_at) = 1)"""
        size, alike, broad = sig("(ips - 5) / 2.0"), sig("(cohesion - 0.4) / 0.12"), sig("(attack - 8) / 5.0")
        turns, many, wide = sig("(rotation - 0.8) / 0.1"), sig("(ip_count - 5) / 2.0"), sig("(path_union_size - 20) / 10.0")
        vol, div = sig("(volume - 100) / 50.0"), sig("(unique_paths - 80) / 40.0")
        days = "(CASE WHEN isinf(burst_sec) THEN 0 ELSE burst_sec / 86400.0 END)"
        burst = f"(CASE WHEN burst_sec < 60 THEN 1.0 ELSE greatest({_ZERO}, 1 - (burst_sec - 60) / 540.0) END)"
        self.scores = self.metrics + f""",
s1 AS (SELECT 'subnet-fingerprint-overlap' AS strategy_id, epoch, end_ms, g.subnet AS key, 'subnet-fingerprint-overlap|subnet=' || g.subnet AS identifier, {size} * 0.4 + greatest({alike}, {broad}) * 0.6 AS confidence, concat_ws('|', cohesion, ips, attack, paths) AS ev
  FROM (SELECT g.*, coalesce(c.cohesion, 0) AS cohesion FROM (SELECT epoch, end_ms, subnet, first(asn ORDER BY ms, id) AS asn, count(DISTINCT ip) AS ips, count(DISTINCT CASE WHEN is_attack THEN route END) AS attack, count(DISTINCT route) AS paths
    FROM nt GROUP BY ALL) g LEFT JOIN cohesion c USING (epoch, asn, subnet)) g WHERE asn IS NOT NULL AND ips >= 3 AND attack >= 1 AND paths >= 2),
s2 AS (SELECT 'asn-path-fingerprint-cluster' AS strategy_id, epoch, end_ms, CAST(asn AS VARCHAR) AS key, 'asn-path-fingerprint-cluster|asn=' || asn || '|fp=' || fingerprint AS identifier, {turns} * 0.5 + {many} * 0.3 + {wide} * 0.2 AS confidence, concat_ws('|', fingerprint, ip_count, path_union_size, rotation) AS ev
  FROM dominant JOIN (SELECT p.epoch, p.asn, avg(ua_diversity) AS rotation FROM prints p JOIN dominant d USING (epoch, asn, fingerprint) JOIN per_ip q ON q.epoch = p.epoch AND q.ip = p.ip GROUP BY ALL) USING (epoch, asn)
  JOIN (SELECT DISTINCT epoch, end_ms FROM e) USING (epoch) WHERE ip_count >= 3),
tool AS (SELECT * FROM e WHERE {' OR '.join(f'regexp_matches(user_agent, {_re(p)})' for p in catalog.tools)}),
s3 AS (SELECT 'ua-reputation' AS strategy_id, epoch, end_ms, ip AS key, 'ua-reputation|ip=' || ip AS identifier, CAST(0.5 AS DOUBLE) AS confidence, concat_ws('|', array_to_string(list_sort(list(DISTINCT user_agent)), ','), count(*)) AS ev FROM tool GROUP BY epoch, end_ms, ip),
s4 AS (SELECT 'single-ip-burst' AS strategy_id, g.epoch, end_ms, g.ip AS key, 'single-ip-burst|ip=' || g.ip AS identifier, {vol} * 0.4 + {div} * 0.4 + greatest({burst}, {sig(f'({days} - 7) / 3.0')}) * 0.2 AS confidence, concat_ws('|', volume, unique_paths, burst_sec) AS ev
  FROM (SELECT epoch, end_ms, ip, any_value(subnet) AS subnet FROM t GROUP BY epoch, end_ms, ip) g JOIN per_ip p ON g.epoch = p.epoch AND g.ip = p.ip
  WHERE NOT EXISTS (SELECT 1 FROM s1 f WHERE f.confidence >= {MIN_CONFIDENCE} AND f.key = g.subnet AND f.epoch <= g.epoch AND f.end_ms + {MARKER_MS} > g.end_ms)),
fired AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4) WHERE confidence >= {MIN_CONFIDENCE}),
seen AS (SELECT 'subnet-fingerprint-overlap' AS strategy_id, subnet AS key, nt.* FROM nt UNION ALL SELECT 'asn-path-fingerprint-cluster', CAST(asn AS VARCHAR), t.* FROM t SEMI JOIN (SELECT epoch, asn, ip FROM prints JOIN dominant USING (epoch, asn, fingerprint)) m USING (epoch, asn, ip)
  UNION ALL SELECT 'ua-reputation', ip, tool.* FROM tool UNION ALL SELECT 'single-ip-burst', ip, t.* FROM t),
shown AS (SELECT s.* FROM seen s SEMI JOIN fired f USING (strategy_id, epoch, key)),
paths AS (SELECT strategy_id, epoch, key, array_to_string(list(route ORDER BY seen_at)[1:10], '|') AS sample_paths_probed
  FROM (SELECT strategy_id, epoch, key, route, min((ms, id)) AS seen_at FROM shown GROUP BY ALL) GROUP BY ALL),
agents AS (SELECT strategy_id, epoch, key, array_to_string(list(user_agent ORDER BY seen_at)[1:5], '|') AS sample_user_agents
  FROM (SELECT strategy_id, epoch, key, user_agent, min((ms, id)) AS seen_at FROM shown WHERE user_agent IS NOT NULL GROUP BY ALL) GROUP BY ALL),
addresses AS (SELECT strategy_id, epoch, key, array_to_string(list(ip ORDER BY seen_at), '|') AS contributing_ips
  FROM (SELECT strategy_id, epoch, key, ip, min((ms, id)) AS seen_at FROM shown GROUP BY ALL) GROUP BY ALL),
cand AS (
  SELECT f.strategy_id, f.epoch, f.key, f.identifier, f.confidence, f.ev, min(created_at) AS first_seen, max(created_at) AS last_seen,
    count(*) AS request_count, list_sort(list(DISTINCT ip)) AS ips
  FROM fired f JOIN shown s ON s.strategy_id = f.strategy_id AND s.epoch = f.epoch AND s.key = f.key
  GROUP BY f.strategy_id, f.epoch, f.key, f.identifier, f.confidence, f.ev)"""

    def of(self, *parts: str) -> str:
        *ctes, query = parts
        return "WITH " + ",\n".join(ctes) + f"\n{query}"

    def source(self) -> str:
        bots = " OR ".join(f"regexp_matches(user_agent, {_re(p)})" for p in self.c.bots)
        return f"""CASE WHEN coalesce(user_agent, '') = '' THEN 'no-agent' WHEN regexp_matches(user_agent, '(?i)^curl/') THEN 'curl' WHEN regexp_matches(user_agent, '(?i)postman') THEN 'postman'
 WHEN regexp_matches(user_agent, '(?i)insomnia') THEN 'insomnia' WHEN {bots} THEN 'bot' WHEN regexp_matches(user_agent, '(?i)mozilla|chrome|safari|firefox|edge|opera') THEN 'browser' ELSE 'unknown' END"""

    def clusters(self, key: str, having: str) -> str:
        rows = f"r AS (SELECT *, {key} AS key FROM cls WHERE {key} IS NOT NULL)"
        hits = """hits AS (SELECT key, full_url, count(*) AS n, min(id) AS seen_at FROM r GROUP BY ALL),
top AS (SELECT key, array_to_string(list(n || 'x ' || full_url ORDER BY n DESC, seen_at)[1:40], '|') AS top_paths FROM hits GROUP BY key)"""
        return self.of(f"{self.cls},\n{rows},\n{hits}", f"""SELECT * FROM (
SELECT key, count(*) AS request_count, count(DISTINCT ip) AS unique_ips, count(DISTINCT full_url) AS unique_paths, count(DISTINCT nullif(substr(user_agent, 1, 160), '')) AS ua_count,
  count(*) FILTER (coalesce(is_tor, false)) AS tor_count, count(*) FILTER (threat_rank = 0) AS none_count, count(*) FILTER (threat_rank = 1) AS low_count,
  count(*) FILTER (threat_rank = 2) AS medium_count, count(*) FILTER (threat_rank = 3) AS high_count, min(created_at) AS first_seen, max(created_at) AS last_seen,
  array_to_string(list_sort(list(DISTINCT method)), '|') AS methods, {samples('r', 'ip', 15)} AS ips, {samples('r', "nullif(substr(user_agent, 1, 160), '')", 8)} AS user_agents,
  {samples('r', 'nullif(asn, 0)')} AS asns, {samples('r', "nullif(org, '')", 5)} AS orgs
FROM r GROUP BY key HAVING {having}) JOIN top USING (key)""")

    def all(self) -> dict[str, str]:
        o, c = self.of, self.c
        types = "asn_types(asn, kind) AS (VALUES " + ", ".join(f"({a}, {_text(k)})" for a, k in c.asn_types) + ")"
        by_org = " ".join(f"WHEN regexp_matches(coalesce(org, ''), {_text('(?i)' + pattern)}) THEN {_text(kind)}" for kind, pattern in c.org_types)
        ip_type = f"CASE WHEN coalesce(req.asn, 0) <> 0 THEN coalesce(kind, CASE {by_org} ELSE 'unknown' END) END"
        chain = "list_filter(list_transform(string_split(coalesce(xff, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
        proposals = []
        for p in PROPOSALS:
            pat = _re(Pattern(p["pattern"], p.get("flags", "i")))
            in_body = f" OR coalesce(regexp_matches(request_body, {pat}), false)" if p.get("target") == "BODY_THREATS" else ""
            ordinary = ", ".join(f"({_text(r)})" for r in ORDINARY_ROUTES)
            proposals.append(f"SELECT {_text(p['name'])} AS name, {_text(p.get('target', 'PATH_THREATS'))} AS target, count(*) AS shapes_hit, count(*) FILTER (u > 0) AS newly_caught_shapes, CAST(coalesce(sum(u), 0) AS BIGINT) AS rows_newly_caught,"
                             f" (SELECT count(*) FROM (VALUES {ordinary}) v(r) WHERE regexp_matches(r, {pat})) AS ordinary_hits FROM (SELECT method, full_url, count(*) FILTER (threat_rank = 0) AS u FROM cls WHERE regexp_matches(full_url, {pat}){in_body} GROUP BY ALL)")  # fmt: skip
        kind = "CASE strategy_id " + " ".join(f"WHEN {_text(x.strategy_id)} THEN {_text(x.campaign_type)}" for x in STRATEGIES) + " END"
        tags = "CASE strategy_id " + " ".join(f"WHEN {_text(x.strategy_id)} THEN {_text('|'.join(x.tags))}" for x in STRATEGIES) + " END"
        s, co, b = sig("(distinct_ips - 5) / 2.0"), sig("(cohesion_attack - 0.4) / 0.12"), sig("(attack_path_count - 8) / 5.0")

        def alike(name: str, rows: str) -> str:
            return f"""{name}_r AS (SELECT DISTINCT epoch, subnet, ip, route FROM {rows}), {name}_k AS (SELECT a.epoch, a.subnet, a.ip, count(DISTINCT b.route) AS k FROM w a LEFT JOIN {name}_r b USING (epoch, subnet, ip) GROUP BY ALL),
{name}_b AS (SELECT a.epoch, a.subnet, a.ip, b.ip AS ip2, count(*) AS n FROM {name}_r a JOIN {name}_r b USING (epoch, subnet, route) WHERE a.ip < b.ip GROUP BY ALL),
{name}_t AS (SELECT h.epoch, h.subnet, sum(n / CAST(x.k + y.k - n AS DOUBLE)) AS total FROM {name}_b h JOIN {name}_k x USING (epoch, subnet, ip) JOIN {name}_k y ON y.epoch = h.epoch AND y.subnet = h.subnet AND y.ip = h.ip2 GROUP BY ALL),
{name} AS (SELECT epoch, subnet, CASE WHEN n > 1 THEN coalesce(total, 0) / (n * (n - 1) / 2.0) ELSE 0 END AS {name} FROM (SELECT epoch, subnet, count(*) AS n FROM {name}_k GROUP BY ALL) LEFT JOIN {name}_t USING (epoch, subnet))"""

        tuning = self.cls + f""",
w0 AS (SELECT *, {subnet('ip')} AS subnet FROM cls WHERE threat_rank > 0 AND NOT coalesce(is_tor, false)), w1 AS (SELECT *, min(ms) OVER () AS a, max(ms) OVER () AS b FROM w0 WHERE subnet IS NOT NULL),
w AS (SELECT *, CAST((ms - a) // {WINDOW_MS} AS INT) AS epoch FROM w1 WHERE a + ((ms - a) // {WINDOW_MS}) * {WINDOW_MS} < b), wa AS (SELECT * FROM w WHERE path_rank > 0),
{alike('cohesion_attack', 'wa')}, {alike('cohesion_all', 'w')},
g AS (SELECT epoch, subnet, count(DISTINCT ip) AS distinct_ips, count(DISTINCT route) AS union_size, count(DISTINCT CASE WHEN path_rank > 0 THEN route END) AS attack_path_count, max(path_rank) AS max_path_rank FROM w GROUP BY ALL),
f AS (SELECT *, {co} * 0.5 + {s} * 0.3 + {b} * 0.2 AS baseline, {s} * 0.4 + greatest({co}, {b}) * 0.6 AS max_or, {s} * 0.3 + {co} * 0.3 + {b} * 0.4 AS weighted, {s} * 0.34 + least(1.0, {co} + {b}) * 0.66 AS sum_cap
  FROM g JOIN cohesion_attack USING (epoch, subnet) JOIN cohesion_all USING (epoch, subnet) WHERE distinct_ips >= 3 AND attack_path_count >= 1)"""
        epochs = lambda win, step: o(self.v4, f"""SELECT CAST(k AS INT) AS epoch, from_ms + k * {step} AS start_ms, least(from_ms + k * {step} + {win}, to_ms) AS end_ms, (SELECT count(*) FROM v4 WHERE ms >= b.from_ms + k * {step} AND ms < least(b.from_ms + k * {step} + {win}, b.to_ms)) AS requests
FROM (SELECT DISTINCT from_ms, to_ms FROM v4) b, range(0, 100000) r(k) WHERE from_ms + k * {step} < to_ms""")  # noqa: E731
        score = lambda s: o(self.scores, f"SELECT epoch, key, identifier, round(confidence, 6) AS confidence FROM {s}")
        first = f"greatest(0, CAST(floor((ms - from_ms - {WINDOW_MS}) / {FINE_STEP_MS}.0) AS BIGINT) + 1)"
        sliding = f"s AS (SELECT *, CAST(unnest(range({first}, (ms - from_ms) // {FINE_STEP_MS} + 1)) AS INT) AS epoch FROM v4)"
        return {
            "classify_levels": o(self.cls, f"SELECT source, method, {level('threat_rank')} AS threat_level, count(*) AS requests FROM (SELECT *, {self.source()} AS source FROM cls) GROUP BY ALL"),
            "source_mix": o(self.req, f"SELECT {self.source()} AS source, count(*) AS requests FROM req GROUP BY ALL"),
            "signals_exploded": o(self.cls, """SELECT id, 'path' AS category, sev AS severity, descr AS description, full_url AS matched FROM req JOIN path_hits USING (full_url)
UNION ALL SELECT id, 'url', sev, descr, NULL FROM req JOIN url_hits USING (full_url)
UNION ALL SELECT id, 'body', sev, descr, NULL FROM req JOIN body_hits USING (request_body)
UNION ALL SELECT id, 'method', sev, descr, CASE WHEN exact THEN method END FROM req JOIN method_hits USING (method)
UNION ALL SELECT id, 'agent', 'low', 'no user agent', NULL FROM req WHERE coalesce(user_agent, '') = ''"""),
            "method_threats": o(self.cls, "SELECT method, sev AS severity, descr AS description, count(*) AS requests FROM req JOIN method_hits USING (method) WHERE exact GROUP BY ALL"),
            "body_threats_documents": o(_table("body_p", c.bodies), "SELECT descr AS description, sev AS severity, count(*) AS documents FROM documents JOIN body_p ON regexp_matches(text, pat) GROUP BY ALL"),
            "url_threats_pages": o(_table("path_p", c.paths), f"SELECT descr AS description, sev AS severity, count(*) AS pages FROM (SELECT url || [{', '.join(map(_text, PAGE_ENDS))}][page_id % {len(PAGE_ENDS)} + 1] AS url FROM pages) JOIN path_p ON regexp_matches(url, pat) GROUP BY ALL"),
            "path_severity": o(self.cls, f"SELECT full_url, {level('coalesce(rnk, 0)')} AS severity, count(*) AS requests FROM req LEFT JOIN path_rank USING (full_url) GROUP BY ALL"),
            "bot_user_agents": o(self.req, f"SELECT user_agent, {self.source()} AS source, count(*) AS requests FROM req WHERE user_agent IS NOT NULL GROUP BY ALL"),
            "ip_type": o(f"{self.req}, {types}", f"SELECT req.asn, org, {ip_type} AS ip_type, count(*) AS requests FROM req LEFT JOIN asn_types USING (asn) GROUP BY ALL"),
            "ip_type_unknown_triage": o(f"{self.req}, {types}", f"SELECT asn, org, count(*) AS hits FROM (SELECT req.asn, org, {ip_type} AS kind FROM req LEFT JOIN asn_types USING (asn)) WHERE kind = 'unknown' GROUP BY ALL"),
            "tor_flag": o(self.req, "SELECT ip, starts_with(ip, '192.42.116.') AND CAST(CASE WHEN contains(ip, ':') THEN '1' ELSE string_split(ip, '.')[4] END AS INT) % 3 = 0 AS is_tor, count(*) AS requests FROM req GROUP BY ALL"),
            "address_locations": o(
                self.req,
                f"addresses AS (SELECT ip, {key_bits('ip')} AS bits FROM (SELECT DISTINCT ip FROM req))",
                located("city_of", CITIES_SQL, ["country", "city", "latitude", "longitude"]),
                located("net_of", NETWORKS_SQL, ["asn", "org"]),
                """SELECT ip, country, nullif(city, '') AS city, latitude, longitude, CAST(net_of.asn AS INT) AS asn, net_of.org AS org, count(*) AS requests
FROM req LEFT JOIN city_of USING (ip) LEFT JOIN net_of USING (ip) GROUP BY ALL""",
            ),
            "forwarding_chain": o(self.req, f"""SELECT id, CASE WHEN known THEN len(chain) END AS hops, CASE WHEN known AND len(chain) > 2 THEN true END AS spoofed, CASE WHEN known AND len(chain) > 2 THEN chain[1] END AS claimed_ip, CASE WHEN known THEN country END AS cf_ip_country
FROM (SELECT *, {chain} AS chain, edge IS NOT NULL OR country IS NOT NULL OR len({chain}) >= 2 AS known
FROM (SELECT id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN ip WHEN 2 THEN ip || ' , 10.0.0.1' ELSE ip || ',10.0.0.1,, 172.16.0.1 ' END AS xff, CASE WHEN id % 5 = 0 THEN ip END AS edge, CASE WHEN id % 7 = 0 THEN 'US' END AS country FROM req))"""),
            "redaction": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type
  ELSE '{"user":{"PassWord":"[REDACTED]","id":' || user_id || '},"list":[{"token":"[REDACTED]"},{"note":"' || event_type || '"}],"k":null}' END AS body FROM events""",
            "parsed_access_log": o(self.req, "SELECT ip, date_trunc('second', created_at) AS created_at, method, full_url, user_agent, 200 AS status_code FROM req"),
            "subnet24": o(self.req, f"SELECT {subnet('ip')} AS subnet, count(DISTINCT ip) AS ips, count(*) AS requests FROM req GROUP BY ALL"),
            "window_scan": o(self.req, "SELECT id, ip, created_at FROM req WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-12' AND NOT contains(ip, ':')"),
            "threats_only": o(self.cls, "SELECT id, ip, threat_rank FROM cls WHERE NOT contains(ip, ':') AND threat_rank > 0 AND NOT coalesce(is_tor, false)"),
            "incremental_rows": o(self.req, f"SELECT id, ip, full_url FROM req WHERE id > {SINCE_ID}"),
            "recent_requests": o(self.req, f"SELECT id, created_at, ip, full_url FROM req ORDER BY created_at DESC, id DESC LIMIT {RECENT_ROWS}"),
            "epochs_tumbling": epochs(WINDOW_MS, WINDOW_MS), "epochs_sliding": epochs(SLIDE_WINDOW_MS, SLIDE_STEP_MS),
            "per_ip_metrics": o(self.metrics, "SELECT epoch, ip, volume, unique_paths, round(burst_sec, 3) AS burst_sec, round(ua_diversity, 6) AS ua_diversity FROM per_ip"),
            "sliding_ip_metrics": o(self.v4, sliding, """SELECT epoch, ip, count(*) AS volume, count(DISTINCT route) AS unique_paths,
  round(CASE WHEN count(*) < 2 THEN CAST('inf' AS DOUBLE) ELSE (max(ms) - min(ms)) / 1000.0 END, 3) AS burst_sec,
  round((count(DISTINCT user_agent) + max(CAST(user_agent IS NULL AS INT))) / CAST(count(*) AS DOUBLE), 6) AS ua_diversity
FROM s GROUP BY epoch, ip"""),
            "sliding_asn_metrics": o(self.v4, sliding, """SELECT epoch, asn, count(DISTINCT ip) AS distinct_ips, count(DISTINCT CASE WHEN is_attack THEN route END) AS path_union_size
FROM s WHERE threat_rank > 0 AND NOT coalesce(is_tor, false) AND asn IS NOT NULL GROUP BY epoch, asn"""),
            "asn_metrics": o(self.metrics, "SELECT epoch, asn, count(DISTINCT ip) AS distinct_ips, count(DISTINCT CASE WHEN is_attack THEN route END) AS path_union_size FROM nt WHERE asn IS NOT NULL GROUP BY ALL"),
            "subnet_cohesion": o(self.metrics, "SELECT epoch, asn, subnet, round(cohesion, 6) AS cohesion FROM cohesion"),
            "fingerprint_clusters": o(self.metrics, "SELECT epoch, asn, fingerprint, ip_count, path_union_size FROM groups"),
            "dominant_cluster": o(self.metrics, "SELECT * FROM dominant"),
            "strategy_subnet_overlap": score("s1"), "strategy_asn_cluster": score("s2"), "strategy_ua_reputation": score("s3"), "strategy_single_ip_burst": score("s4"),
            "marker_suppression": o(self.scores, f"SELECT key AS scope_value, max(end_ms) + {MARKER_MS} AS expires_ms FROM fired WHERE strategy_id = 'subnet-fingerprint-overlap' GROUP BY key"),
            "candidates_all": o(self.scores, f"""SELECT strategy_id, epoch, identifier, round(confidence, 6) AS confidence, {band('confidence')} AS campaign_threat_level,
  {kind} AS campaign_type, {tags} AS related_strategy_tags, first_seen, last_seen, request_count,
  sample_paths_probed, coalesce(sample_user_agents, '') AS sample_user_agents, contributing_ips
FROM cand JOIN paths USING (strategy_id, epoch, key) LEFT JOIN agents USING (strategy_id, epoch, key) JOIN addresses USING (strategy_id, epoch, key)"""),
            "candidate_report": o(self.scores, """SELECT identifier, epoch, round(confidence, 6) AS confidence, CASE WHEN k > 1 THEN 'updated' ELSE 'inserted' END AS outcome, k AS times_fired
FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY epoch) AS k FROM cand)"""),
            "known_answer_replay": o(self.metrics, f"SELECT epoch, ip_count, path_union_size, ip_count >= 3 AS as_expected FROM dominant WHERE asn = {KNOWN_ASN}"),
            "campaign_fold": o(self.scores, """SELECT identifier, any_value(strategy_id) AS strategy_id, count(*) AS times_fired, min(first_seen) AS first_seen, max(last_seen) AS last_seen, round(max(confidence), 6) AS peak_confidence, round(arg_max(confidence, epoch), 6) AS confidence,
  array_to_string(list_sort(list_distinct(flatten(list(ips)))), ',') AS contributing_ips FROM cand GROUP BY identifier"""),
            "campaigns_active": o(self.scores, "SELECT identifier, round(max(confidence), 6) AS peak_confidence FROM cand GROUP BY identifier"),
            "evidence_history": o(self.scores, """SELECT identifier, CAST(row_number() OVER (PARTITION BY identifier ORDER BY epoch) - 1 AS INT) AS nth, last_seen AS observed_at, round(confidence, 6) AS confidence
FROM (SELECT *, lag(ev) OVER (PARTITION BY identifier ORDER BY epoch) AS before FROM cand) WHERE before IS DISTINCT FROM ev"""),
            "catalog_coverage": "SELECT *, campaign_type IN (" + ", ".join(_text(x.campaign_id) for x in c.campaigns) + ") AS catalogued FROM (VALUES "
            + ", ".join(f"({_text(t)}, {_text(i)})" for i, t in [*((x.strategy_id, x.campaign_type) for x in STRATEGIES), ("sibling", SIBLING)]) + ") v(campaign_type, strategy_id)",
            "uncaught_shapes": o(self.cls + ",\nr AS (SELECT * FROM cls WHERE threat_rank = 0)", f"""SELECT method, full_url, count(*) AS count, count(DISTINCT ip) AS ip_count, {samples('r', 'id', 5)} AS sample_ids,
  {samples('r', "nullif(substr(user_agent, 1, 160), '')", 5)} AS user_agents, {samples('r', 'ip', 10)} AS ips, {samples('r', 'status_code')} AS status_codes, {samples('r', 'stored_level')} AS stored_levels,
  {samples('r', "CASE WHEN request_body NOT IN ('{}', '') THEN substr(request_body, 1, 300) END", 3)} AS request_bodies
FROM r GROUP BY method, full_url"""),
            "clusters_by_ip": self.clusters("ip", "count(*) >= 10 OR count(DISTINCT full_url) >= 5"),
            "clusters_by_subnet": self.clusters(subnet("ip"), "count(DISTINCT ip) >= 2 AND (count(*) >= 10 OR count(DISTINCT full_url) >= 3)"),
            "clusters_by_asn": self.clusters("CASE WHEN coalesce(asn, 0) <> 0 THEN 'AS' || asn || ' ' || coalesce(org, '') END", "count(DISTINCT ip) >= 3 AND count(DISTINCT full_url) >= 3"),
            "level_histogram": o(self.cls, f"SELECT {level('threat_rank')} AS threat_level, count(*) AS requests FROM cls GROUP BY ALL"),
            "score_tuning": o(tuning, "SELECT subnet, epoch, distinct_ips, union_size, attack_path_count, max_path_rank, round(cohesion_attack, 6) AS cohesion_attack, round(cohesion_all, 6) AS cohesion_all, round(baseline, 6) AS baseline, round(max_or, 6) AS max_or, round(weighted, 6) AS weighted, round(sum_cap, 6) AS sum_cap FROM f QUALIFY row_number() OVER (PARTITION BY subnet ORDER BY max_or DESC, epoch) = 1"),
            "pattern_validation": o(self.cls, " UNION ALL ".join(proposals)),
            "credential_probes_by_asn": o(self.cls, "SELECT asn, count(*) AS probes, count(DISTINCT ip) AS ips FROM req WHERE asn IS NOT NULL AND full_url IN (SELECT full_url FROM path_hits WHERE contains(descr, 'credential')) GROUP BY ALL"),
            "catalog_campaigns": "SELECT * FROM (VALUES " + ", ".join(f"({_text(x.campaign_id)}, {_text(x.severity)}, {_text(x.detection_type)}, {x.n_sources}, {x.n_paths})" for x in c.campaigns) + ") v(campaign_id, severity, detection_type, n_sources, n_paths)",
        }
