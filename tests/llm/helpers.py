"""Small documents with all that an operator must stand: nulls, empty and long texts, copies, clashing columns."""

import os
import random
from pathlib import Path

# Python workers of the session find the package by this; test modules are imported before the session starts.
ROOT = str(Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, component_id string, ids string"


def odd_texts(seed=7, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß 's") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(80)]
    out = [None, "", " ", "\n\n", "a", "A", "don't", "  x", "<|endoftext|>", "x<|endoftext|>y", "ünï cødé — \U0001f600", "a" * 3000, "\x00\x1c"]
    for _ in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))
        if rng.random() < 0.4:
            other = rng.choice(out) or ""
            at = rng.randint(0, max(0, len(other) - 1))
            text += other[at : at + rng.randint(30, 300)]
        out.append(text)
    out.append(" ".join(rng.choice(words) for _ in range(20_000)))
    return out


def documents(spark, texts=None, ids=None):
    texts = odd_texts() if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, ("en", None)[k % 2], "s", 1, 5, "clash", "clash") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DDL).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DDL)
