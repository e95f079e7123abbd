"""Tables that the tests of the subpackage share."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, `class` string, shard string, seen int"
SYLLABLES = {"xa": "ka lo mi ten sur".split(), "xb": "zhu prin dov eck uth".split(), "xc": "ñe çua õli été ïro".split()}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents(n=60, seed=1):
    """Rows of DOCS: plain texts of three languages, the odd cases last."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        text = sentence(rng, lang, rng.randint(20, 60)).capitalize() + "."
        rows.append((i, text, lang, f"s{i % 4}", len(text), "r", "s", "c", "h", 1))
    odd = [
        (n, None, None, None, None), (n + 1, "", "xa", "s0", 0), (n + 2, " \n\t ", "xb", None, 4), (n + 3, "12345 !!", None, "s1", 8),
        (n + 4, sentence(rng, "xa", 40_000), "xa", "s2", None), (None, sentence(rng, "xb", 30), "xb", "s3", 1),
    ]
    rows += [(*r, None, None, None, None, None) for r in odd]
    return rows + [rows[0], rows[0], rows[n]]  # repeated rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
