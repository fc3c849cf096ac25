import random
import re

import numpy as np
import pytest

from glossa.llm.decontaminate import contaminated

ITEM = "A train leaves Boston with Alice at 7 and rides 120 km to meet Bruno near Boston before 9 and rests there"


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as item_id", "3 as id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as at")
    return {(r.id, r.item_id): r for r in contaminated(d, b, **more).collect()}


@pytest.mark.parametrize("most_keys", [1_000_000, 0])
def test_changed_slots(spark, most_keys):
    changed = ITEM.replace("Boston", "Denver").replace("Alice", "Carla").replace("7", "8").replace("120", "4.5").replace("km", "miles")
    mixed = ITEM.replace("Boston", "Denver", 1).replace("Alice", "Carla").replace("120", "45")
    other = "Quite another text with 7 and 120 km in it that Alice wrote about Boston and about Bruno for no reason"
    docs = [(1, "before. " + ITEM + ". after"), (2, "before. " + changed), (3, mixed), (4, other), (5, ITEM.upper()), (6, None), (7, "")]
    got = run(spark, docs, [(10, ITEM), (11, None), (12, "")], most_keys=most_keys)
    assert set(got) == {(1, 10), (2, 10), (5, 10)}  # Boston became both Denver and Boston in 3
    assert got[2, 10].reparameterised and not got[1, 10].reparameterised
    assert got[1, 10].coverage == 1.0


def brute(docs, items, w=5):
    def wins(t):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        k = min(w, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    found = set()
    for i, t in items:
        a = wins(t)
        found |= {(d, i) for d, s in docs if a and len(a & wins(s)) / len(a) >= 0.8}
    return found


def test_plain_text_matches_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("aeiorstn", k=4)) for _ in range(200)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 40)))) for i in range(25)]
    docs = []
    for d in range(150):
        words = rng.choices(vocab, k=rng.randrange(0, 200))
        part = items[d % 25][1].split()
        if d % 3 == 0:
            cut = rng.choice([len(part), len(part), int(len(part) * 0.9), len(part) // 2])
            words[len(words) // 2 : len(words) // 2] = part[:cut]
        docs.append((d, " ".join(words)))
    docs += [(500, items[0][1]), (501, "aa bb"), (501, "aa bb")]
    items += [(90, "aa bb"), (90, "aa bb")]
    assert set(run(spark, docs, items)) == brute(docs, items)


def forms(text):
    """For each window: {form: its slots' values}, by the definition, one window at a time."""
    units = {"km", "miles", "kg", "dollars", "hours"}
    tokens = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]|\d+(?:[.,]\d+)*", text or "")
    words = []  # (lower-case word, kind, kind if first words are names)
    for i, t in enumerate(tokens):
        if t in ".!?\n":
            continue
        title = len(t) > 1 and t[0].isupper() and t[1:].islower()
        first = i == 0 or tokens[i - 1] in ".!?\n"
        kind = "number" if t[0].isdigit() else "unit" if t.lower() in units and i and tokens[i - 1][0].isdigit() else "name" if title and not first else ""
        words.append((t.lower(), kind, kind or ("name" if title else "")))
    k, out = min(5, len(words)), []
    for p in range(len(words) - k + 1 if words else 0):
        win, got = words[p : p + k], {}
        for kinds in ([""] * k, [w[1] for w in win], [w[2] for w in win]):
            if k - sum(map(bool, kinds)) >= 2:
                got[tuple(f"<{x}>" if x else w[0] for w, x in zip(win, kinds, strict=True))] = [w[0] if x else None for w, x in zip(win, kinds, strict=True)]
        if not any(any(w[1:]) for w in win) or not got:
            got[tuple(w[0] for w in win)] = [None] * k
        out.append(got)
    return out


def brute_templates(docs, items):
    found = set()
    for i, item in items:
        theirs = forms(item)
        for d, text in docs:
            runs = {}
            for p, ours in enumerate(forms(text)):
                for q, got in enumerate(theirs):
                    for form in ours.keys() & got.keys():
                        pairs = [(a, b) for a, b in zip(got[form], ours[form], strict=True) if a is not None]
                        runs.setdefault(p - q, []).append((q, pairs))
            at = set()
            for hits in runs.values():
                pairs = {x for _, ps in hits for x in ps}
                fine = len({a for a, _ in pairs}) == len(pairs)
                at |= {q for q, ps in hits if fine or all(a == b for a, b in ps)}
            if theirs and len(at) / len(theirs) >= 0.8:
                found.add((d, i))
    return found


def test_templates_match_brute_force(spark):
    rng = random.Random(4)
    names, units = ["Tom", "Anna", "Bruno", "Carla", "Denver"], ["km", "kg", "hours", "dollars"]
    vocab = "gives buys a the apples and of them friend how many does have now to with from sells red".split()

    def text(n):
        out = []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.15:
                out.append(rng.choice(names))
            elif kind < 0.3:
                out += [str(rng.randrange(2, 60)), rng.choice(units)]
            else:
                out.append(rng.choice(vocab) + rng.choice(["", "", "", ".", "?"]))
        return " ".join(w.capitalize() if i == 0 or out[i - 1][-1] in ".?" else w for i, w in enumerate(out))

    items = [(i, text(rng.randrange(6, 30))) for i in range(12)]
    docs = []
    for d in range(90):
        part = items[d % 12][1]
        swap = dict(zip(names, rng.sample(names, 5), strict=True))
        change = rng.random()
        if change < 0.4:
            part = re.sub("[A-Z][a-z]+", lambda m: swap.get(m[0], m[0]), part)
        if 0.2 < change < 0.7:
            numbers = {}
            part = re.sub(r"\d+", lambda m: numbers.setdefault(m[0], str(rng.randrange(2, 99))), part)
        if change > 0.6:
            part = re.sub(r"\d+", lambda m: str(rng.randrange(2, 99)), part, count=2)
        docs.append((d, text(rng.randrange(0, 40)) + ". " + part + " " + text(rng.randrange(0, 20))))
    got = set(run(spark, docs, items))
    assert got == brute_templates(docs, items) and 30 < len(got) < 110


def test_names_that_begin_sentences(spark):
    item = "Tom has 5 apples and buys 3 more. Tom gives 2 of them to a friend. How many apples does Tom have now"
    assert set(run(spark, [(1, item.replace("Tom", "Anna")), (2, item.replace("Tom", "Anna", 2).replace("Tom", "Bert"))], [(7, item)])) == {(1, 7)}


def test_rows_of_one_id_are_judged_apart(spark):
    words = ITEM.split()
    halves = [(5, " ".join(words[:13])), (5, " ".join(words[9:])), (6, ITEM), (6, "clean")]
    assert set(run(spark, halves, [(1, ITEM)])) == {(6, 1)}


def test_empty_tables(spark):
    assert not run(spark, [], [(1, ITEM)])
    assert not run(spark, [(1, ITEM)], [])
    assert not run(spark, [(1, ITEM)], [(None, ITEM)])
    assert set(run(spark, [(None, ITEM)], [(1, ITEM)])) == {(None, 1)}


def test_very_long_text_and_many_copies(spark):
    docs = [(1, "x y z. " * 100_000 + ITEM)] + [(i, ITEM + ". " + ITEM) for i in range(2, 300)]
    assert len(run(spark, docs, [(1, ITEM)])) == 299


def test_ascii_tokens_and_sift():
    from glossa.llm.decontaminate import FIND, FIND_ASCII, Sift, Vocabulary

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices("abZ'_.,!?\n 019-\t\x00", k=rng.randrange(60)))
        assert FIND_ASCII(text) == FIND(text)
    got = Vocabulary().windows("Tom has 5 km to go. Anna has 7,5 kg of it")[2][0][1]
    keys = np.sort(got[::2])
    assert Sift(keys)(got).tolist() == np.flatnonzero(np.isin(got, keys)).tolist()
    assert Sift(keys[:0])(got).tolist() == []
