"""Small tables with nulls, empties, ties, repeats, long texts and columns that clash with the operators' own names."""

import random


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(n)]
    passage = words(rng, 30, 10**6)
    rows = []
    for k, w in enumerate(base):
        w = list(w)
        if k % 5 == 1:
            w = list(base[k - 1])  # exact copy
        elif k % 5 == 2:
            w = list(base[k - 2])
            w[rng.randrange(len(w))] = "changed"  # near copy
        elif k % 5 == 3:
            at = rng.randrange(len(w))
            w = w[:at] + passage + w[at:]
        rows.append((k, " ".join(w), ["en", "de", None][k % 3], f"src{k % 4}", "x", "y", 1, "z", "q"))
    rows += [
        (n, None, "en", None, "x", "y", 1, "z", "q"),
        (n + 1, "", None, "src0", "x", "y", 1, "z", "q"),
        (n + 2, " \t\n", "en", "src0", None, None, None, None, None),
        (n + 3, "Ünïcode ÀB\u00a0c  d\te\x1cf 🙂 " * 5, "fr", "src1", "x", "y", 1, "z", "q"),
        (n + 4, " ".join(words(rng, 20_000)), "en", "src1", "x", "y", 1, "z", "q"),
        (n + 5, "one", "en", "src1", "x", "y", 1, "z", "q"),
        (None, "a row without an id " + " ".join(passage), "en", "src1", "x", "y", 1, "z", "q"),
        (0, rows[0][1], "en", "src0", "x", "y", 1, "z", "q"),  # a repeated row
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, starts string, key string, n int, rep string, component_id string")


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
