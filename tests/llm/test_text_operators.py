import itertools
import math
import random
import re
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import documents, frame, sentence

from leverscope.llm import chat, common, decontamination, language, language_model, privacy, quality

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, least, most in ((2, CARD, 13, 19), (3, PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                out.append((kind, *m.span()))
    return out


# ---- language

def test_languages_are_told_apart_and_odd_texts_rejected(spark):
    rows = documents(120)
    docs = frame(spark, rows)
    model = language.learn(docs.filter("doc_id % 4 <> 2"))
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    texts = {r[0]: (r[1], r[2]) for r in rows}
    plain = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 120]
    assert all(r["lang_pred"] == texts[r["doc_id"]][1] and 0 <= r["score"] <= 1 and not r["rejected"] for r in plain)
    for r in got:
        text = texts[r["doc_id"]][0]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    strange = frame(spark, [(1, "Жд щю йы ъэ жщ", "ru", None, 0, None, None, None, None, 0)])
    assert language.identify(strange, model).first()["rejected"]


def test_language_counts_equal_brute_force():
    texts = ["Ab, c!", "", "ÉÉ a-b", "x" * 5000, "12"]

    def grams(text):
        out = Counter()
        for word in re.findall(r"[^\W\d_]+", text):
            padded = f" {word.lower()} "
            out.update(word.lower())
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    cell, number = language.counts(texts, 1 << 20)
    for i, text in enumerate(texts):
        mine = number[(cell >> 20) == i]
        assert sorted(mine.tolist()) == sorted(grams(text).values()), text


def test_language_scores_equal_brute_force(spark):
    """TF-IDF, spread-out starts, spherical k-means and nearest centroid, written out over a dictionary of n-grams."""
    rng = random.Random(12)
    rows = [(i, sentence(rng, ["xa", "xb", "xc"][i % 3], rng.randint(3, 9)), ["xa", "xb", "xc"][i % 3]) for i in range(60)]
    rows += [(60, None, "xa"), (61, "12 !", "xb"), (62, rows[0][1], None), rows[4]]

    def grams(text):
        out = Counter()
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            out.update(f" {word} "[i : i + n] for n in (1, 2, 3) for i in range(len(word) + 3 - n) if f" {word} "[i : i + n] != " ")
        return out

    known = [r for r in rows if r[2] is not None]
    frequency = Counter(g for r in known for g in grams(r[1]))
    names = {g: k for k, g in enumerate(sorted(frequency))}
    idf = {g: np.log((1 + len(known)) / (1 + n)) + 1 for g, n in frequency.items()}

    def unit(text):
        v = np.zeros(len(names))
        for g, n in grams(text).items():
            v[names[g]] = (1 + np.log(n)) * idf[g]
        return v / (np.sqrt(v @ v) or 1)

    centres = []
    for lang in ("xa", "xb", "xc"):
        x = np.array([unit(t) for t in sorted({r[1] for r in known if r[2] == lang and grams(r[1])})])
        starts = [max(range(len(x)), key=lambda i: float(x[i] @ x.mean(0)))]
        while len(starts) < 3:
            starts.append(min(range(len(x)), key=lambda i: max(float(x[i] @ x[s]) for s in starts)))
        own = x[starts]
        for _ in range(language.ROUNDS):
            nearest = [max(range(3), key=lambda k: float(v @ own[k])) for v in x]
            own = np.array([np.mean([v for v, k in zip(x, nearest) if k == c] or [own[c]], axis=0) for c in range(3)])
            own /= np.linalg.norm(own, axis=1, keepdims=True)
        centres += [(lang, c) for c in own]

    docs = frame(spark, rows, "doc_id long, text string, lang string")
    model = language.learn(docs, dimensions=1 << 18, clusters=3)
    assert (model["idf"] < max(model["idf"])).sum() == len(names)  # no two n-grams share a feature
    got = language.identify(docs, model, reject_below=0.3).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        likeness, lang = max((float(unit(text) @ c), lang) for lang, c in centres)
        want = (lang, likeness) if grams(text) else ("und", 0.0)
        assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 1e-5 and r["rejected"] == (want[1] < 0.3), (text, r, want)


def test_a_language_of_many_copies_of_few_texts_is_learnt(spark):
    texts = [(" ".join(f"{chr(97 + k)}{chr(97 + k)}{w}" for w in ("ra", "to", "li")) + " " + "xyz"[i] * 3, f"l{k}") for k in range(10) for i in range(2)]
    docs = frame(spark, texts, "text string, lang string").crossJoin(spark.range(2500)).selectExpr("id as doc_id", "text", "lang")
    model = language.learn(docs)
    assert set(model["langs"]) == {lang for _, lang in texts}
    once = frame(spark, [(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(once, model).collect()} == {i: lang for i, (_, lang) in enumerate(texts)}


def test_language_without_rows_or_labels(spark):
    nothing = frame(spark, [])
    model = language.learn(nothing)
    assert language.identify(nothing, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(frame(spark, documents(3)), model).collect()} == {"und"}
    kept = language.keep_identified(frame(spark, documents(30)), language.learn(frame(spark, documents(30))))
    assert kept.columns == frame(spark, []).columns and kept.filter("text is null").count() == 0


# ---- quality

def test_quality_separates_held_out_junk(spark):
    rng = random.Random(4)
    rows, good = [], []
    for i in range(400):
        clean = i % 5 > 0
        text = sentence(rng, "xa", 80) if clean else rng.choice([" ".join([sentence(rng, "xa", 1)] * 60), sentence(rng, "xa", 60).upper().replace(" ", "!! ")])
        rows.append((i, text))
        good.append(clean)
    odd = [(400, None), (401, ""), (402, "  "), (None, "a b"), (3, rows[3][1])]
    docs = frame(spark, [(i, t, None, None, None, "x", "x", "x", "x", 0) for i, t in rows + odd])
    trusted = frame(spark, [(i,) for i in range(0, 300) if good[i] and i % 2], "doc_id long")
    model = quality.learn(docs.filter("doc_id < 300 or doc_id is null"), trusted)
    assert 0.6 < model.prior < 0.99
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    assert all(r["predicted"] == good[r["doc_id"]] for r in held)
    assert quality.learn(docs, trusted.limit(0)) is None
    assert {r["score"] for r in quality.score(docs.limit(3), None).collect()} == {0.5}
    assert quality.score(frame(spark, []), model).count() == 0


def test_quality_scores_and_prior_equal_brute_force(spark):
    """Means, deviations, the estimated prior and every score, row by row in plain Python."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, "xa", rng.randint(1, 60)) if i % 3 else " ".join(["spam"] * rng.randint(1, 50))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, rows[1][1]), rows[2]]
    good = {i for i in range(300) if i % 3 and i % 2} | {302}
    docs = frame(spark, rows, "doc_id long, text string")
    model = quality.learn(docs, frame(spark, [(i,) for i in good], "doc_id long"))

    x = [[float(np.float32(v)) for v in quality.features(t)] for _, t in rows]
    mean = [sum(c) / len(rows) for c in zip(*x)]
    scale = [max(sum(v * v for v in c) / len(rows) - m * m, 0) ** 0.5 + 1e-6 for c, m in zip(zip(*x), mean)]
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale, rtol=1e-4, atol=1e-5)

    def chance(one, weights):
        z = [min(max((v - m) / s, -quality.CLIP), quality.CLIP) for v, m, s in zip(one, model.mean, model.scale)]
        g = sum(w * v for w, v in zip(weights, [1.0, *z, *[v * v for v in z[1:]]]))
        return 1 / (1 + np.exp(-min(max(g, -30), 30)))

    want = {r[0]: chance(one, model.weights) for r, one in zip(rows, x)}
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-9 for r in got)

    table = frame(spark, [(np.array(one, np.float32).tobytes(), r[0] in good) for r, one in zip(rows, x)], "x binary, trusted boolean")
    n, k = len(rows), sum(r[0] in good for r in rows)
    bins = [(min(int(quality.BINS * chance(one, model.weights)), quality.BINS - 1), r[0] in good) for r, one in zip(rows, x)]
    slack = sum((np.log(40) / (2 * m)) ** 0.5 for m in (n, k))
    ratios = []
    for b in range(quality.BINS):
        u, p = sum(c >= b for c, _ in bins) / n, sum(c >= b and t for c, t in bins) / k
        ratios.append(((u + slack) / max(p, 1e-12), u / max(p, 1e-12)))
    least = min(ratios, key=lambda r: r[0])[1]
    assert abs(quality._prior(table, model.mean, model.scale, model.weights, k, n) - min(max(least, 0.01), 0.99)) < 1e-9


def test_risk_is_least_where_the_fit_stops(spark):
    """The fitted weights against the risk itself, written out."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, len(quality.NAMES))).astype(np.float32)
    positive = (x[:, 0] + 0.5 * rng.standard_normal(4000) > -0.5) & (rng.random(4000) < 0.4)
    table = frame(spark, [(r.tobytes(), bool(p)) for r, p in zip(x, positive)], "x binary, trusted boolean")
    mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    w = quality._fit(table, mean, scale, 0.5, positive.sum(), 4000)

    def risk(w):
        g = quality._design(x.astype(float), mean, scale) @ w
        soft = lambda z: np.logaddexp(0, z)
        inner = soft(g).mean() - 0.5 * soft(g[positive]).mean()
        assert inner > 0  # the smooth part
        return 0.5 * soft(-g[positive]).mean() + max(0, inner) + quality.RIDGE / 2 * (w[1:] ** 2).sum()

    best = risk(w)
    for _ in range(60):
        assert risk(w + 0.01 * rng.standard_normal(len(w))) >= best - 1e-9


# ---- personal data

def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    parts = ["a", "b.", "@", "@x.", "c-d", "1", "2", "12", "255", ".", ".", " ", "-", "+", "(", ")", "4111111111111111", "é", "_", "%", "300", "\n", "z@q.io", "٣"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert privacy.base_spans(text) == plain_spans(text), text


def test_beliefs_are_exact_on_a_tree():
    potentials = privacy.Potentials({("shape:10/3(", 3): 50, ("shape:10/3", 4): 9, ("after:3", 3): 20, ("same", 1): 30})
    text = "call +1 (988) 555-2485 now" + " " * 100 + "or 988-555-2485"
    mentions = privacy.Mentions(text)
    # Keys of both strengths join the two: keep the strong one, so that the graph is a tree.
    mentions.forms = [(s, [k for k in keys if k[1]], kinds) for s, keys, kinds in mentions.forms]
    got = privacy.beliefs(mentions, potentials)
    size, weight = privacy.OUTSIDE + 1, np.zeros(privacy.OUTSIDE + 1)
    own = potentials.unary(mentions.forms[1][0], mentions.forms[1][2])
    for label, key in itertools.product(range(size), repeat=2):
        weight[label] += math.exp(own[label] + potentials.same[True][mentions.labels[0], key] + potentials.same[True][key, label])
    assert np.allclose(got[1], weight / weight.sum(), atol=1e-3)


def test_repeats_of_a_number_are_marked_and_strangers_left_alone():
    potentials = privacy.Potentials({("shape:10/3(", 3): 50})
    text = "Call +1 (988) 555-2485, then 988-555-2485. In 2019 we sold 1234567 of 98765432."
    base, spans = privacy.spans_of(text, potentials)
    assert [text[s:e] for _, s, e in spans] == ["+1 (988) 555-2485", "988-555-2485"] and len(base) == 1
    assert privacy.redacted(text, spans).startswith("Call [PHONE], then [PHONE]. In 2019")


def test_tags_of_odd_rows(spark):
    rows = documents(10) + [(50, "a@b.co 10.0.0.1 +1 (988) 555-2485; 4111 1111 1111 1111", None, None, None, None, None, None, None, None)]
    docs = frame(spark, rows)
    potentials = privacy.learn(docs)
    got = privacy.tag(docs, potentials).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert [r[f"n_{k}"] for k in privacy.KINDS] == [Counter(k for k, _, _ in plain_spans(texts[r["doc_id"]]))[i] for i in range(4)]
    assert [r["redacted"] for r in got if r["doc_id"] == 50] == ["[EMAIL] [IP] [PHONE]; [CARD]"]
    clean = privacy.redact(docs, potentials)
    assert clean.columns == docs.columns and clean.filter("doc_id = 50").first()["n_chars"] is not None
    assert privacy.tag(frame(spark, []), privacy.learn(frame(spark, []))).count() == 0
    for text in ("1" * 100_000, "a" * 100_000 + "@" + "b" * 100_000, "+1" + "." * 100_000 + "x", "1.2.3." * 30_000):
        privacy.spans_of(text, potentials)


def test_fifty_thousand_addresses_in_one_text_take_seconds():
    text = " ".join(f"name{i}@host.example and name{i}" for i in range(50_000))
    start = time.perf_counter()
    base, spans = privacy.spans_of(text, privacy.Potentials({("same", 1): 30}))
    assert time.perf_counter() - start < 60
    assert len(base) == 50_000 and len(spans) >= 50_000


def test_names_are_found_where_plain_search_finds_them():
    rng = random.Random(4)
    for _ in range(200):
        names = {"".join(rng.choices("ab1", k=rng.randint(3, 8))) for _ in range(6)}
        text = "".join(rng.choices("ab1 ", k=120))
        wanted = [n for n in names if len(n) >= 5 and not n.isalpha()]
        assert privacy.Mentions._names(text, names) == sorted((m.start(), m.start() + len(n)) for n in wanted for m in re.finditer(f"(?={re.escape(n)})", text))


# ---- decontamination

def least_edits(item, text):
    """Edit distance of the item to the nearest region, over the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, "xb", rng.randint(8, 25))) for i in range(12)] + [(90, "too short"), (91, None), (92, ""), (0, None)]
    docs = []
    for i in range(60):
        text = sentence(rng, "xb", 40)
        if i % 2:
            own = list(items[i % 12][1])
            for _ in range(rng.randint(0, int(0.1 * len(own)))):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = rng.choice(["", "Q", "ZZ"])
            text = f"{text} {''.join(own).upper() if i % 4 == 1 else ''.join(own)}\n\n{text}"
        docs.append((i, text))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, items[4][1] * 1), (102, items[4][1])]
    benchmark = frame(spark, items, "item_id long, text string")
    df = frame(spark, [(i, t, None, None, None, "x", "x", "x", "x", 0) for i, t in docs])
    got = decontamination.contaminated(df, benchmark).collect()
    norm = lambda t: decontamination.normalised(np.frombuffer(t.encode(), np.uint8))[0].tobytes().strip()
    want = []
    for i, text in docs:
        for item, t in items:
            if text and t and len(norm(t)) >= decontamination.SHORTEST:
                edits = least_edits(norm(t), norm(text))
                if edits <= decontamination.budget(len(norm(t))):
                    want.append((-1 if i is None else i, item, edits))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"], r["edits"]) for r in got) == sorted(want)
    assert len(want) > 15
    kept = decontamination.without_leaks(df, benchmark)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if (-1 if i is None else i) not in {w[0] for w in want})
    assert decontamination.contaminated(df, frame(spark, [], "item_id long, text string")).count() == 0
    assert decontamination.contaminated(frame(spark, []), benchmark).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, sentence(rng, "xa", 15)) for i in range(6)]
    benchmark, docs = frame(spark, items, "item_id long, text string"), frame(spark, [(i, "pre " + items[i % 6][1]) for i in range(9)], "doc_id long, text string")
    want = sorted(map(tuple, decontamination.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 150)
    assert sorted(map(tuple, decontamination.contaminated(docs, benchmark).collect())) == want and len(want) == 9


def brute_regions(index, text):
    """Every band of every item by counting distinct hit places one by one."""
    out = set()
    grams = [bytes(text[i : i + decontamination.Q]) for i in range(len(text) - decontamination.Q + 1)]
    for i, item in enumerate(index.texts):
        if len(item) < decontamination.SHORTEST:
            continue
        width, length = int(index.budgets[i]) + 1, len(item)
        at = {}
        for p in range(length - decontamination.Q + 1):
            at.setdefault(bytes(item[p : p + decontamination.Q]), []).append(p)
        held = {}
        for x, g in enumerate(grams):
            for p in at.get(g, ()):
                band = (x - p + length + width) // width
                held.setdefault(band, set()).add(x)
                held.setdefault(band - 1, set()).add(x)
        for band, places in held.items():
            if len(places) >= index.least[i]:
                first = band * width - length - width
                out.update((i, d) for d in range(first, first + 2 * width))
    return out


@pytest.mark.parametrize("window", [1 << 20, 1])
def test_bands_hold_what_counting_one_by_one_finds(monkeypatch, window):
    monkeypatch.setattr(decontamination, "WINDOW", window)
    rng = random.Random(8)
    items = [bytes(rng.choices(b"ab", k=60)), b"_" * 70, b"ab" * 40, b"abcd" * 30 + b"_" * 50, bytes(rng.choices(b"abcdefgh", k=90))]
    index = decontamination.Index(list(enumerate(items)), decontamination.ERRORS)
    for _ in range(12):
        parts = [bytes(rng.choices(b"ab_", k=rng.randint(0, 80))) for _ in range(3)] + [rng.choice(items)[rng.randint(0, 9) :], b"_" * rng.randint(0, 200), b"ab" * rng.randint(0, 60)]
        rng.shuffle(parts)
        text = np.frombuffer(b"".join(parts), np.uint8)
        got = {(i, d) for i, first, last in index.regions(text) for d in range(first, last + 1)}
        want = brute_regions(index, text)
        assert got >= want and (window == 1 or got == want)


def test_repetitive_texts_and_items_stay_small():
    item = b"Name: " + b"_" * 200 + b" Date: " + b"_" * 200
    index = decontamination.Index([(1, item), (2, b"x" * 1_000_000), (3, b"yes")], decontamination.ERRORS)
    start = time.perf_counter()
    for text in (b"_" * 5_000_000, b"before " + item + b" after", b"z" * 100 + b"x" * 1_000_100, b"Yes, yes", b"yesterday"):
        clean = decontamination.normalised(np.frombuffer(text, np.uint8))[0]
        found = set(decontamination._found_in(index, clean))
        # The underscores alone lie within the first item's 32 edits.
        assert found == ({0} if text[:1] in b"_b" else {1} if text[:1] == b"z" else {2} if text.startswith(b"Yes") else set())
    assert time.perf_counter() - start < 120
    index = decontamination.Index([(1, item)], decontamination.ERRORS)
    tracemalloc.start()
    assert decontamination._found_in(index, np.frombuffer(b"_" * 5_000_000, np.uint8))
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_short_items_are_found_as_whole_words(spark):
    docs = frame(spark, [(1, "So: What  is IT? Yes."), (2, "whatis it?"), (3, "What is it"), (4, "")], "doc_id long, text string")
    items = frame(spark, [(1, "what is it?"), (2, "what is it"), (3, ""), (4, None)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminated(docs, items).collect())
    assert got == [(1, 1, 0), (1, 2, 0), (3, 2, 0)]
    assert sorted(r[0] for r in decontamination.without_leaks(docs, items).collect()) == [2, 4]


# ---- language model

def tokens(text):
    return (text or "").encode().lower().split() + ["end"]


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, "xa", rng.randint(0, 30)).replace("kaka", "Ka")) for i in range(80)] + [(80, None), (81, ""), (82, "unseen words only"), (None, "ka lo"), (3, "ka")]
    train = [t for i, t in rows if i is None or i % 3]
    model = language_model.learn(frame(spark, [(t,) for t in train], "text string").repartition(3))
    got = language_model.score(frame(spark, rows, "doc_id long, text string"), model).collect()
    words, pairs = Counter(), Counter()
    for t in train:
        w = tokens(t)
        words.update(w)
        pairs.update(zip(["start", *w], w))
    n, v = sum(words.values()), len(words)

    def discounts(counts):
        c = [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
        return [0] + [min(max(k - (k + 1) * c[0] / (c[0] + 2 * c[1]) * c[k] / c[k - 1], 0), k) if c[0] and c[1] and c[k - 1] and c[k] else k / 2 for k in (1, 2, 3)]

    left = Counter(w for _, w in pairs)
    d, d1 = discounts(pairs.values()), discounts(left.values())
    spared, total, mass = sum(d1[min(x, 3)] for x in left.values()), Counter(), Counter()
    for (a, _), x in pairs.items():
        total[a] += x
        mass[a] += d[min(x, 3)]
    lower = lambda w: (left[w] - d1[min(left[w], 3)]) / len(pairs) + spared / len(pairs) / (v + 1)

    def chance(a, w):
        x = pairs[a, w]
        return lower(w) if not total[a] else (x - d[min(x, 3)]) / total[a] + mass[a] / total[a] * lower(w)

    assert abs(sum(chance(b"ka", w) for w in words) + chance(b"ka", b"?") - 1) < 1e-9
    by = {(r["doc_id"], r["n_tokens"]): r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        w = tokens(t)
        r = by[i, len(w)]
        assert (r["n_known"], r["train_tokens"]) == (sum(x in words for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(chance(a, x)) for a, x in zip(["start", *w], w)))


def test_a_model_of_nothing(spark):
    nothing = frame(spark, [], "doc_id long, text string")
    model = language_model.learn(nothing)
    assert language_model.score(nothing, model).count() == 0
    r = language_model.score(frame(spark, [(1, "a b")], "doc_id long, text string"), model).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


# ---- chat

def brute_repair(roles):
    """All role sequences, each priced from the automaton; ties by the reversed sequence."""
    best = None
    seen = [r if r in chat.ROLES else None for r in roles]
    for out in itertools.product(range(3), repeat=len(roles)):
        cost, before = 0, 3
        for role, to in zip(seen, out):
            cost += 0 if role == chat.ROLES[to] else 1 if role is None else 3
            if before == to:
                cost += 1
            elif (before, to) in chat.BETWEEN:
                cost += 2 * len(chat.BETWEEN[before, to])
            else:
                cost += 10**6
            before = to
        cost += 2 * len(chat.CLOSING[before])
        key = (cost, out[::-1])
        if best is None or key < best:
            best = key
    return [chat.ROLES[r] for r in best[1][::-1]]


def test_repairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 2)  # long conversations are composed from runs
    rng = random.Random(11)
    rows, want = [], {}
    for conv in range(60):
        roles = [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.randint(1, 7))]
        want[conv] = brute_repair(roles)
        rows += [(conv, i, r, f"t{i}", 5) for i, r in enumerate(roles)]
    rows += [(None, 0, "User ", None, 1), (None, None, "bot", "x <|im_end|> y", 1), (0, 0, *rows[0][2:])]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string, position int")
    got = chat.repair(df).orderBy("conv_id", "position").collect()
    for conv in range(60):
        assert [r["role_out"] for r in got if r["conv_id"] == conv] == want[conv], conv
        assert [r["position"] for r in got if r["conv_id"] == conv] == list(range(len(want[conv])))
        text = "".join(r["piece"] for r in got if r["conv_id"] == conv)
        said = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
        names = [s[0] for s in said]
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in said) == text
        assert names[-1] == "assistant" and all((a, b) in (("system", "user"), ("user", "assistant"), ("assistant", "user")) for a, b in zip(names, names[1:]))
    assert [r["copies"] for r in got if r["conv_id"] == 0][0] == 2
    assert [r["piece"] for r in got if r["conv_id"] is None] == ["<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\nx < |im_end|> y<|im_end|>\n"]
    assert chat.repair(df.limit(0)).count() == 0


def test_fold_is_the_checksum_of_the_id(spark):
    got = spark.range(50).select("id", common.fold(common.F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
