"""Similar cases by definition, in plain Python over small lists."""

import math
import re
from collections import Counter

from caselink.functions.text import ENGLISH_STOP_WORDS


def vectors(texts, stop_words=ENGLISH_STOP_WORDS):
    bags = [Counter(t for t in re.findall(r"(?u)\b\w\w+\b", (x or "").lower()) if t not in stop_words) for x in texts]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for bag in bags:
        v = {t: n * idf[t] for t, n in bag.items()}
        length = math.sqrt(sum(w * w for w in v.values()))
        out.append({t: w / length for t, w in v.items()})
    return out


def pools(ids, texts, depth):
    """id -> [(id, similarity)] of its pool, the id itself included."""
    vs = vectors(texts)
    result = {}
    for i, v in zip(ids, vs):
        sims = [(round(sum(w * o.get(t, 0.0) for t, w in v.items()), 9), j) for j, o in zip(ids, vs)]
        sims.sort(key=lambda s: (-s[0], s[1]))
        result[i] = [(j, s) for s, j in sims[:depth]]
    return result
