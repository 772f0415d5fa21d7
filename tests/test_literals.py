"""The screen never keeps a pattern from a text that it matches."""

import random
import re

import pytest
from gatewatch import catalogs
from gatewatch.functions.literals import Screen, required
from gatewatch.operators.classify import scan, screened


@pytest.mark.parametrize(("pattern", "clauses"), [
    (r"UNION\s+(ALL\s+)?SELECT", [{"union"}, {"select"}]),
    (r"\/(mail|smtp)(\.config)?\.(js|php)\b", [{"/mail.config.js", "/mail.config.php", "/mail.js", "/mail.php", "/smtp.config.js", "/smtp.config.php", "/smtp.js", "/smtp.php"}]),
    (r"a|b\d", [{"a", "b"}]), (r"a?b", [{"b", "ab"}]), (r"(x|)y*", []), (r"(ab)+c", [{"ab"}, {"c"}]), (r"(?!no)yes$", [{"yes"}]), (r"[abc]z", [{"az", "bz", "cz"}]),
    (r"[^a]z", [{"z"}]), (r"\d{2}x", [{"x"}]), (r"q{0,3}x", [{"x"}]), (r"é", []), (r"\$\(.*?\)|`.*?`", [{"$(", "`"}]),
])
def test_clauses(pattern, clauses):
    assert required(pattern) == [frozenset(c) for c in clauses] or {frozenset(c) for c in clauses} == set(required(pattern))


def spelled(rng, pattern):
    """Some text near what a pattern asks for: its source with alternatives picked and marks dropped."""
    text = pattern
    while found := re.search(r"\((?:\?:)?([^()]*)\)[?*+]?", text):
        text = text[: found.start()] + rng.choice(found[1].split("|")) + text[found.end() :]
    text = rng.choice(text.split("|"))
    text = re.sub(r"\\[sS][+*]?", " ", re.sub(r"\\d[+*]?", "7", re.sub(r"\\w[+*]?", "w", text)))
    text = re.sub(r"\\b|[$^]|\{\d+,?\d*\}|\.\*\?", "", text)
    text = re.sub(r"\\(.)|\[(.)[^\]]*\]|[?*+]", lambda m: m[1] or m[2] or "", text)
    return "".join(c.upper() if rng.random() < 0.3 else c for c in text)


def test_catalog_patterns_are_never_kept_from_a_match():
    rng = random.Random(3)
    c = catalogs.load()
    patterns = [*c.paths, *c.bodies]
    screen = Screen([p.pattern for p in patterns])
    assert sum(map(bool, screen.clauses)) > 0.9 * len(patterns)
    matched = tried = 0
    for p in patterns:
        for _ in range(12):
            text = rng.choice(["", "/x", "é "]) + spelled(rng, p.pattern) + rng.choice(["", " ", "/", "é"])
            mask = screen.mask(text)
            for k, q in enumerate(patterns):
                if mask[k // 62] >> k % 62 & 1:
                    tried += 1
                elif re.search(q.pattern, text, re.I if q.ignore_case else 0):
                    raise AssertionError((q.pattern, text))
                matched += 1
    assert tried < 0.1 * matched


def test_scan_with_a_screen_gives_the_same_signals(spark):
    rng = random.Random(4)
    bodies = catalogs.load().bodies
    texts = [None, "", "calm text", "union ALL select", "<SCRIPT>", "a' or 1=1", *(f"x {spelled(rng, p.pattern)} y" for p in bodies for _ in range(4))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = rows.select("text", scan("text", bodies, "body").alias("s"))
    masked = screened(rows, "text", bodies, "mask").select("text", scan("text", bodies, "body", mask="mask").alias("s"))
    key = lambda df: sorted((r.text or "", len(r.s), [x.description for x in r.s]) for r in df.collect())
    assert key(plain) == key(masked) and sum(n > 0 for _, n, _ in key(plain)) > len(bodies)
