import random
import tracemalloc

import numpy as np

from itemloom.llm import toxicity


def test_a_fit_holds_its_features_and_a_block_of_numbers():
    deal = random.Random(2)
    words = ["".join(deal.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(4_000)]
    texts = [" ".join(deal.choice(words) for _ in range(1_500)) for _ in range(700)]
    labels = [int(i % 5 == 0) for i in range(700)]
    texts = [t + (" nasty" if y else "") for t, y in zip(texts, labels)]
    features = sum(len(toxicity.buckets(t)) for t in texts)
    tracemalloc.start()
    weights, intercept = toxicity.fit(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert features > 5_000_000 and peak < 12 * features + (64 << 20)
    scores = np.array([toxicity.score(t, weights, intercept) for t in texts])
    assert scores[::5].min() > scores[1::5].max()
