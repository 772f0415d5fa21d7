"""Language votes, the recurrent network's pass and the quality margin, each in a few plain loops."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from gatewatch.llm import language, quality, toxicity

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def texts(n=60, seed=4):
    rng = random.Random(seed)
    words = ["tea", "Straße", "the", "und", "été", "x1", "日本", "a-b", "don't", "WORD", "word", "...", "über", "qq"]
    return ["", " ", "12 34 !!", *(" ".join(rng.choice(words) + rng.choice(["", "", ",", "!"]) for _ in range(rng.randint(1, 120))) for _ in range(n))]


def grams_of(text):
    """Codes of the n-grams of letters, runs of anything else as one blank, which stands at an n-gram's ends only."""
    letters = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    points = [0]
    for p in [*letters, 0]:
        if p or points[-1]:
            points.append(p)
    out = []
    for n in (2, 3, 4):
        for i in range(len(points) - n + 1):
            gram = points[i : i + n]
            if all(gram[1:-1]) and any(gram):
                code = n
                for p in gram:
                    code = (code * 0x100000001B3 + p) & M64
                out.append(code)
    return out, any(letters)


def slots_of(code):
    h = ((code ^ code >> 31) * 0xBF58476D1CE4E5B9) & M64
    h ^= h >> 29
    return [h >> (64 - language.SLOT_BITS - 20 * k) & ((1 << language.SLOT_BITS) - 1) for k in range(language.HASHES)]


@pytest.mark.parametrize("languages", [1, 3, 70])
def test_language_votes(languages):
    rng = random.Random(languages)
    learned = {f"l{k:02}": {c for t in texts(4, seed=k) for c in grams_of(t)[0] if rng.random() < 0.5} for k in range(languages)}
    model = language.LanguageFilter({lang: np.array(sorted(codes), dtype=np.uint64) for lang, codes in learned.items()})
    slots = {lang: {s for c in codes for s in slots_of(c)} for lang, codes in learned.items()}
    wrong = {lang: (len(s) / 2**language.SLOT_BITS) ** language.HASHES for lang, s in slots.items()}
    for text in texts():
        codes, any_letter = grams_of(text)
        if not any_letter:
            assert model.predict(text) == ("und", 0.0)
            continue
        hits, n = dict.fromkeys(slots, 0), 0
        for code in codes:
            holding = [lang for lang, s in slots.items() if all(x in s for x in slots_of(code))]
            if languages > 1 and len(holding) == languages:
                continue
            n += 1
            for lang in holding:
                hits[lang] += 1
        votes = {lang: max(hits[lang] - n * wrong[lang], 0) / (1 - wrong[lang]) for lang in slots}
        assert model.votes(text).tolist() == pytest.approx([votes[lang] for lang in sorted(slots)])
        best = max(sorted(votes), key=votes.get)
        second = max([v for lang, v in votes.items() if lang != best], default=0.0)
        score = votes[best] / (votes[best] + second) if votes[best] + second else 0.0
        assert model.predict(text) == (best, pytest.approx(score))


def window_logit(net, words):
    """One window, word by word and direction by direction."""
    h, width = toxicity.HIDDEN, toxicity.WIDTH
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    inputs = []
    for w in words:
        w = w.strip(".,;:!?\"'()[]{}*#%&$|") or w
        marked = f"^{w}$"
        rows = []
        for i in range(len(marked) - 2):
            a, b, c = map(ord, marked[i : i + 3])
            g = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & M32
            g ^= g >> 15
            rows.append((g * 0x27D4EB2F & M32) % toxicity.GRAM_ROWS)
        own = net.word[zlib.crc32(w.encode()) % toxicity.WORD_ROWS]
        x = [float(own[k]) + sum(float(net.gram[r][k]) for r in rows) / len(rows) for k in range(width)]
        inputs.append([sum(x[k] * float(net.p["wx"][k][j]) for k in range(width)) + float(net.p["bx"][j]) for j in range(6 * h)])
    inputs += [[0.0] * 6 * h] * (toxicity.WINDOW - len(words))
    states = [[0.0] * 2 * h for _ in inputs]
    for d in (0, 1):
        state, u = [0.0] * h, net.p["u"][d]
        for t in range(len(inputs)) if d == 0 else reversed(range(len(inputs))):
            x = inputs[t][3 * h * d : 3 * h * (d + 1)]
            hu = [sum(state[i] * float(u[i][j]) for i in range(h)) for j in range(3 * h)]
            z = [sigmoid(x[j] + hu[j]) for j in range(h)]
            r = [sigmoid(x[h + j] + hu[h + j]) for j in range(h)]
            c = [math.tanh(x[2 * h + j] + r[j] * hu[2 * h + j]) for j in range(h)]
            state = [(1 - z[j]) * c[j] + z[j] * state[j] for j in range(h)]
            states[t][h * d : h * (d + 1)] = state
    real = max(1, len(words)) if words else len(inputs)
    energy = [sum(s * float(a) for s, a in zip(states[t], net.p["att"])) for t in range(real)]
    weight = [math.exp(e - max(energy)) for e in energy]
    pooled = [sum(w * states[t][k] for t, w in enumerate(weight)) / sum(weight) for k in range(2 * h)]
    return sum(p * float(o) for p, o in zip(pooled, net.p["out"])) + float(net.p["b"][0])


def test_recurrent_pass():
    net = toxicity.Network(seed=3)
    rng = np.random.default_rng(1)
    for k in ("bx", "b", "att", "out"):
        net.p[k] = (net.p[k] + rng.standard_normal(net.p[k].shape) * 0.3).astype(np.float32)
    for text in [t for t in texts(10) if t.split() and all(len(w) <= toxicity.LETTERS for w in t.split())]:
        words = text.lower().split()
        starts = range(0, max(1, len(words) - toxicity.STRIDE), toxicity.STRIDE) if len(words) > toxicity.WINDOW else [0]
        want = max(window_logit(net, words[s : s + toxicity.WINDOW]) for s in starts)
        assert float(toxicity.Scorer(net).logits([text])[0]) == pytest.approx(want, abs=2e-4)


def test_quality_margin():
    rng = np.random.default_rng(2)
    model = quality.QualityModel(rng.standard_normal(1 << quality.BITS), rng.random(1 << quality.BITS), 0.3, 2.0, -0.1)
    grams = quality.Grams()

    def slots(units, longest, salt):
        for n in range(1, longest + 1):
            for i in range(len(units) - n + 1):
                g = units[i]
                for u in units[i + 1 : i + n]:
                    g = (g * 0x01000193 + u) & M32
                x = (g ^ (salt * 7919 + n)) * 0x9E3779B1 & M32
                x ^= x >> 15
                yield (x * 0x85EBCA77 & M32) >> (32 - quality.BITS)

    for text in texts():
        words = text.split()
        shapes = [re.sub("[0-9]+", "0", re.sub("[a-zß-öø-ÿ]+", "a", re.sub("[A-ZÀ-ÖØ-Þ]+", "A", re.sub("[aA0]", lambda m: {"a": "b", "A": "B", "0": "1"}[m[0]], w)))) for w in words]
        units = [0x3FFFFFF1 if k and words[k] == words[k - 1] else zlib.crc32(s.encode()) & 0x3FFFFFFF for k, s in enumerate(shapes)]
        found = {*slots([b + 1 for b in text.encode()], 4, 1), *slots(units, 3, 101)}
        want = sum(float(model.weights[k]) for k in found) / math.sqrt(sum(float(model.squares[k]) for k in found) + 1e-9) + 0.3
        assert grams.of(text).tolist() == sorted(found)
        assert model.margin(grams.of(text)) == pytest.approx(want, rel=1e-6)
        assert model.score(grams.of(text)) == pytest.approx(1 / (1 + math.exp(-(2 * want - 0.1))), rel=1e-6)
