"""Toxicity (operator 3): hashed features and FTRL-proximal steps against plain loops with one number at a time."""

import math

import numpy as np
import pytest
import xxhash

from gridlight.llm import toxicity

M = (1 << 64) - 1


def plain_features(text, settings):
    """The set of features of a text, by whole-number arithmetic."""
    words = [xxhash.xxh64_intdigest(w.strip(toxicity.PUNCTUATION) or w) for w in text.lower().split()]
    grams = [(h, 0) for h in words]
    for gap in range(1, settings.skip + 2):
        factor = 0x9E3779B97F4A7C15 + 2 * gap
        grams += [((a * factor & M) ^ (b >> 7) ^ b, 1) for a, b in zip(words, words[gap:])]
    out = set()
    for g, pair in grams:
        g ^= g >> 31
        g = g * 0xBF58476D1CE4E5B9 & M
        g ^= g >> 29
        out.add(g & ((1 << settings.bits) - 2) | pair)
    return out


TEXTS = [b"you are a fool, really", b"a fine day it is", b"fool! you fool", b"the day is fine and the sun is out", b"", b"what a fool you are", b"it is a fine, fine day", b"you, a fool", b"sun and day and sun", b"... !!! fool"] * 3


def test_features():
    settings = toxicity.Settings(bits=14)
    flat, counts = toxicity.Features(settings).of([*TEXTS, None])
    for text, own in zip([*TEXTS, b""], np.split(flat, np.cumsum(counts)[:-1])):
        assert set(own.tolist()) == plain_features(text, settings)


@pytest.mark.parametrize("l1", [0.05, 0.4, 50.0])
def test_learning(l1):
    settings = toxicity.Settings(bits=14, epochs=3, l1=l1, alpha=0.8, least_docs=2)
    labels = np.array([float(b"fool" in t) for t in TEXTS])
    docs = [plain_features(t, settings) for t in TEXTS]
    seen = {}
    for d in docs:
        for f in d:
            seen[f] = seen.get(f, 0) + 1
    docs = [sorted(f for f in d if seen[f] >= settings.least_docs) for d in docs]
    value = lambda f: settings.pair_value if f & 1 else 1.0
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(f):
        zf = z.get(f, 0.0)
        return 0.0 if abs(zf) <= l1 else -(zf - math.copysign(l1, zf)) / ((settings.beta + math.sqrt(n.get(f, 0.0))) / settings.alpha + settings.l2)

    order = np.random.default_rng(7)
    for _ in range(settings.epochs):
        for k in order.permutation(len(docs)).tolist():
            own = {f: weight(f) for f in docs[k]}
            bias = -zb / ((settings.beta + math.sqrt(nb)) / settings.alpha)
            slope = 1 / (1 + math.exp(-(sum(w * value(f) for f, w in own.items()) + bias))) - labels[k]
            for f, w in own.items():
                g = slope * value(f)
                sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / settings.alpha
                z[f], n[f] = z.get(f, 0.0) + g - sigma * w, n.get(f, 0.0) + g * g
            sigma = (math.sqrt(nb + slope * slope) - math.sqrt(nb)) / settings.alpha
            zb, nb = zb + slope - sigma * bias, nb + slope * slope
    index, w, bias = toxicity.learn(TEXTS, labels, settings)
    want = {f: weight(f) * value(f) for f in z if weight(f)}
    assert dict(zip(index.tolist(), w.tolist())) == pytest.approx(want) and bias == pytest.approx(-zb / ((settings.beta + math.sqrt(nb)) / settings.alpha))
    assert l1 < 50 or not want  # a large penalty leaves nothing
