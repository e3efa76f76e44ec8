"""D5 against a plain version that refits the weights for every plan."""

import math
import random
import re
from collections import Counter

from tracekit.operators.diversity import diversity_prior


def plain(texts):
    docs = [Counter(re.findall(r"\b\w\w+\b", (t or "").lower())) for t in texts]
    out = []
    for k, own in enumerate(docs):
        df = Counter(t for d in docs[:k + 1] for t in d)
        w = [{t: n * (math.log((2 + k) / (1 + df[t])) + 1) for t, n in d.items()} for d in docs[:k + 1]]
        size = [math.sqrt(sum(x * x for x in d.values())) for d in w]
        cosines = [sum(x * w[j].get(t, 0.0) for t, x in w[k].items()) / (size[j] * size[k]) if size[j] and size[k] else 0.0
                   for j in range(k)]
        out.append(1.0 if k == 0 else 0.5 if not df else max(1.0 - max(cosines), 0.0))
    return out


def test_diversity(spark):
    rng = random.Random(5)
    vocabulary = ["Add", "the", "numbers", "divide", "by", "total", "x", "Größe", "12", "7", "step_1"]
    runs = {1: [" ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for _ in range(60)],
            2: [None, "", "a b", "add two numbers", "ADD two, numbers!", "", "divide it", "word " * 20_000, "word"],
            3: ["only one"], 4: ["same plan"] * 5, 5: ["", None]}
    rows = [(r * 1000 + k, r, k, t, "x") for r, texts in runs.items() for k, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "problem_id long, run long, pos long, plan string, diversity string")
    got = {r.problem_id: r.diversity for r in diversity_prior(df, "problem_id", "run", "pos", "plan").collect()}
    assert len(got) == len(rows)
    for r, texts in runs.items():
        for k, want in enumerate(plain(texts)):
            assert abs(got[r * 1000 + k] - want) < 1e-9, (r, k)
    assert diversity_prior(df.limit(0), "problem_id", "run", "pos", "plan").count() == 0
