"""The repeats' steps: what they leave on disk, and packs of windows that agree in part."""

import random

import numpy as np
import pandas as pd

from itemloom.llm import suffixes
from test_llm_text import plain_repeats


def shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(blocks.size()) if (name := blocks.apply(k).getName()).startswith("shuffle_")}


def planted(n, seed=7):
    """Texts that share stretches of about WIDTH bytes, cut at any place, in differing surroundings."""
    rng = random.Random(seed)
    words = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    stretches = [words(260) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, 70)
            parts += [words(rng.randint(0, 300)), rng.choice(stretches)[a : a + rng.randint(190, 250)]]
        rows.append((i, "".join(parts)))
    return rows


def test_no_shuffle_files_of_ended_steps(spark):
    docs = spark.createDataFrame(planted(60), "doc_id bigint, text string")
    before = shuffle_files(spark)
    suffixes.without_repeats(docs)
    assert not shuffle_files(spark) - before


def test_packs_that_agree_in_part(spark):
    rows = planted(150)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, suffixes.without_repeats(docs).collect()))
    assert got == sorted(plain_repeats(rows))
    assert 0 < sum(r[2] for r in got) < sum(r[1] for r in got)


def test_sorted_windows_hold_covered_bytes_alone(monkeypatch):
    held_bytes = []
    sort = suffixes.suffix_ranks
    monkeypatch.setattr(suffixes, "suffix_ranks", lambda data, starts, width: held_bytes.append(len(data)) or sort(data, starts, width))
    text = "".join(t for _, t in planted(200))
    places = [at << 32 | 7 << 16 for at in (0, len(text) // 2, len(text) - 300)]
    frame = pd.DataFrame({"text_key": [b"k"], "text": [text], "places": [np.array(places)]})
    (out,) = suffixes._window_rows([frame])
    assert sorted(out["at"]) == sorted(at + k for at in (0, len(text) // 2, len(text) - 300) for k in range(8))
    assert held_bytes == [3 * (suffixes.WIDTH + 7)]
