import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import documents, frame

from leverscope.llm import divergence, structure, token_counts
from leverscope.llm.queries import PIECES

# ---- token counts


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_equal_the_library_on_odd_texts(library):
    count, rng = token_counts.Counter(PIECES), random.Random(5)
    parts = [*count.rank, " ", "  ", "      ", "\t", "\n", "\r", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "日本", "𐍈", "é", "é", "​", "�", "퟿", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts += ["a" * 50_000, "lorem" * 20_000, " " * 30_001, "x y " * 20_000, "🙂" * 3000]
    assert [count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_a_full_table_of_words_changes_no_count(monkeypatch, library):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 5)
    count, rng = token_counts.Counter(PIECES), random.Random(6)
    for _ in range(50):
        text = " ".join("".join(rng.choices("abcdefgh,.", k=rng.randint(1, 90))) for _ in range(20))
        assert count(text) == len(library.encode(text))
        assert len(count.known) <= 5


def test_token_counts_of_a_table(spark, library):
    rows = documents()
    got = sorted(map(tuple, token_counts.count_tokens(frame(spark, rows), PIECES, limit=100).collect()), key=str)
    want = []
    for r in rows:
        n = len(library.encode(r[1] or ""))
        want.append((r[0], len((r[1] or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(frame(spark, []), PIECES).count() == 0


# ---- conversation structure

LEGAL = re.compile("(s?(ua)+)?")


def every_repair(codes):
    """All edits of a short run that lead to a legal sequence, at most two insertions beside one another."""
    best = None
    slots = [list(itertools.chain.from_iterable(itertools.product("ua", repeat=k) for k in range(3))) for _ in range(len(codes) + 1)]
    choices = []
    for c in codes:
        extra = int(c.isupper())
        own = [("D", "", 3)]
        if c != "-":
            own += [("K", c.lower(), extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        choices.append(own)
    for inserted in itertools.product(*slots):
        for edits in itertools.product(*choices):
            roles = "".join("".join(i) + e[1] for i, e in zip(inserted, edits)) + "".join(inserted[-1])
            if LEGAL.fullmatch(roles):
                cost = 2 * sum(map(len, inserted)) + sum(e[2] for e in edits)
                text = "".join("I" * len(i) + e[0] for i, e in zip(inserted, edits)) + "I" * len(inserted[-1])
                if best is None or (cost, text) < best:
                    best = (cost, text)
    return best


def repaired(parts):
    tables = [dict(zip(("costs", "places"), structure._table(p))) for p in parts]
    cost, way = structure._route(tables)
    letters = "".join(structure.solve(p, e)[x][1] for p, (e, x) in zip(parts, way))
    return cost, letters + "I" * structure.CLOSING[way[-1][1]] if way else letters


def test_cost_and_audit_equal_all_repairs_tried_out():
    rng = random.Random(2)
    every = ["".join(c) for n in (1, 2) for c in itertools.product("suaxSUA-", repeat=n)]
    for codes in every + ["".join(rng.choices("suaxSUA-", k=3)) for _ in range(40)] + ["".join(rng.choices("suaUA-", k=4)) for _ in range(4)]:
        assert repaired([codes]) == every_repair(codes), codes


def test_runs_compose_to_the_whole_and_audits_render_legal_sequences():
    rng = random.Random(3)
    for n in [5, 9, 17, 40, 120] * 12:
        codes = "".join(rng.choices("suaxSUAX-", weights=(1, 6, 6, 1, 1, 2, 2, 1, 2), k=n))
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(1, 4))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        assert repaired(parts) == repaired([codes]), codes
        cost, way = structure._route([dict(zip(("costs", "places"), structure._table(codes)))])
        edits = structure._edits(codes, *way[0])
        initials = {"system": "s", "user": "u", "assistant": "a"}
        out = "".join("".join(initials[r] for r in before) + ("" if e == "D" else initials[role] if role else c.lower()) for c, (before, e, role) in zip(codes, edits))
        assert LEGAL.fullmatch(out + "ua"[2 - structure.CLOSING[way[0][1]] :])
    long = "".join(rng.choices("sua-UA", k=1024))
    assert repaired([long]) == repaired([long[:500], long[500:]])


def plain_audit(rows):
    """The contract's query in plain Python; costs by the tried-out or composed repair."""
    out, by = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw:
            text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
            by[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).hexdigest()))
        seen, codes, faults = set(), "", Counter()
        for _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = repaired([codes]) if codes else (0, "")
        lines, at, state = [], 0, ""
        for letter in audit:
            role, text = turns[at][1:] if at < len(turns) and letter != "I" else ("", "")
            at += letter != "I"
            if letter != "D":
                state = "s" if letter == "K" and role.startswith("s") else "a" if state == "u" else "u"
                lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "turn long, conv_id long, role string, text string, rid long, code string, edit string"


@pytest.mark.parametrize("run", [1024, 4])
def test_structure_audit_equals_plain_python(spark, monkeypatch, run):
    monkeypatch.setattr(structure, "RUN", run)
    rng, rows = random.Random(run), []
    for conv in range(80):
        for turn in range(rng.choice((1, 2, 5, 9, 30))):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "sys"])
            text = rng.choice([None, "", " \t\n", "Yes.", "No", "Why?  ", f"Text {turn}.", f"Text {turn}", "x" * 3000 + "!", "é。", "a\x85"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (7, 1, "user", "Yes."), (7, 1, "user", "Yes.")]
    table = frame(spark, [(t, c, r, x, 1, "c", "e") for c, t, r, x in rows], CONVERSATIONS)
    got = {r["conv_id"]: tuple(r)[1:] for r in structure.audit(table).collect()}
    assert got == plain_audit(rows)
    if run == 1024:
        assert structure.audit(frame(spark, [], CONVERSATIONS)).count() == 0


# ---- divergence of sources

def plain_divergence(rows):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, inside = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = word.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        inside[lang or ""].update(set(terms))
    out = []
    for (lang, source), mine in counts.items():
        kept = [t for t, n in inside[lang].items() if n >= 3]

        def chances(number):
            total = sum(number[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (number[t] + 1) // (total + len(kept)) for t in kept}

        p, found = chances(mine), []
        for (l, other), theirs in counts.items():
            if l == lang and other != source:
                q = chances(theirs)
                found.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other.encode()))
        out += [(lang, source, "pair", item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found))]
        whole = Counter()
        for (l, _), number in counts.items():
            if l == lang:
                whole.update(number)
        q = chances(whole)
        own = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if mine[t] and p[t] > q[t])[:200]
        out += [(lang, source, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("held", [400_000, 50])
def test_divergence_equals_plain_python(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rng = random.Random(held)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本", "𐍈x", "a", "zz", "ﬁ", "�"] + [f"w{''.join(rng.choices('abc', k=6))}" for _ in range(700)]
    rows = []
    for _ in range(400):
        text = "".join(rng.choice(words[: rng.choice((10, 60, 710))]) + rng.choice([" ", ", ", "1", "\x00", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice([text, text, text, None]), rng.choice(["en", "en", "fr", None]), rng.choice(["s0", "s0", "s1", "é", "\U00010000", None])))
    rows += [("only once here", "de", "s0"), (None, "de", "s1"), ("x" * 100_000, "en", "s0"), rows[0], rows[0]]
    table = frame(spark, [(n, t, l, s, "i", 1, 2, 3) for n, (t, l, s) in enumerate(rows)],
                  "rank long, text string, lang string, source string, item string, value int, n int, total int")
    assert sorted(map(tuple, divergence.audit(table).collect())) == plain_divergence(rows)
    if held == 50:
        assert divergence.audit(table.limit(0)).count() == 0


def test_divergence_of_terms_in_slices_and_over_batches(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 300)
    rng = random.Random(8)
    rows = [(" ".join(rng.choices(["all", "Every", "été", "b", "c", "d"], weights=(9, 9, 3, 1, 1, 1), k=6)), rng.choice(["en", "fr"]), f"s{n % 13}") for n in range(150)]
    rows += [("all " * 3_000_000, "en", "s0"), ("all", "en", "lone")]
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    table = frame(spark, rows, "text string, lang string, source string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, divergence.audit(table).collect())) == plain_divergence(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_divergence_shuffles_term_counts_once_and_joins_none(spark, monkeypatch):
    plans = []

    def spied(df, name):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] * ("term" in df.columns))
        return stored(df, name)

    stored = divergence.stored
    monkeypatch.setattr(divergence, "stored", spied)
    divergence.audit(frame(spark, [("a b", "en", "s")] * 3, "text string, lang string, source string"))
    assert sum(p.count("Exchange ") for p in plans) == 1
    assert not any("Join" in p for p in plans)
