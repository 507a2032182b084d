"""Spelling variants, filter audit and shingle join against plain models."""

import random
import zlib
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import interaction, multimatch, spelling
from tests.llm.cases import EN, SCHEMA, prose, rows, table


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelling_model(given, every, shortest=5, least=3):
    counts = Counter()
    for doc, text, *_ in given:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
                at = h % len(run)
                counts[run[:at] + run[at + 1 :] if h % every == 0 else run] += 1
                run = ""
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= least}
    found = {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        found[w] = (best if best and n[best] >= 2 * n[w] else None, len(others))
    result = set()
    for w, (form, many) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        result.add((w, form, root, n[w], many, n[form] if form else None))
    return result


def test_spelling_equals_the_model(spark):
    rng = random.Random(3)
    stems = ["colour", "harbour", "straße", "éclair", "Àrbre", "lllll", "llllll", "banana", "bananas", "ananab"]
    given = rows()
    for i in range(40):
        words = []
        for _ in range(80):
            w = rng.choice(stems)
            at = rng.randrange(len(w))
            words.append(rng.choice([w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice("aerß×") + w[at:], w[:at] + "o" + w[at + 1 :], w.upper()]))
        given.append((100 + i, " ".join(words), "en", None, None))
    given.append((500, "z" * 200_000 + " " + "z" * 200_000 + " " + "z" * 200_000, None, None, None))
    for every in (97, 3):
        counted = spelling.word_counts(table(spark, given), every=every)
        found = {tuple(r) for r in spelling.variants(counted).collect()}
        assert found == spelling_model(given, every)
    assert any(f[1] for f in found) and max(f[4] for f in found) > 3


def test_signatures_cover_all_near_words():
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9)))
        at = rng.randrange(len(word))
        for other in (word[:at] + word[at + 1 :], word[:at] + "x" + word[at + 1 :], word[:at] + "a" + word[at:]):
            parts = {(c, t): rng.randrange(spelling.PARTS) for c in "abcd" for t in (1, 2)}
            assert set(spelling.signature_keys(word, parts)) & set(spelling.signature_keys(other, parts))


def test_spelling_of_an_empty_table(spark):
    assert spelling.variants(spelling.word_counts(table(spark, []))).count() == 0


def audit_model(given, labels):
    def fails(i):
        doc, text, *_ = given[i]
        words = (text or "").encode().split()
        text = text or ""
        found = set()
        found |= {"A"} if len(words) < 100 else set()
        found |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        found |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        found |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, *_ in given):
            found.add("E")
        return found

    failing = [fails(i) for i in range(len(given))]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    result = set()
    for part in {r[2] or "" for r in given}:
        ids = [i for i, r in enumerate(given) if (r[2] or "") == part]
        made, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = set(ids)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in failing[i]}
                redundant = sum(f in failing[i] for i in ids if i not in left)
                left -= gone
                shapley[f] += len(gone)
                unique = sum(failing[i] == {f} for i in ids)
                of = lambda s: sum(given[i][0] in s for i in gone)
                made.append((part, order, step, len(left), len(gone), redundant, unique, of(good), of(toxic)))
        result |= {(*m, shapley[m[1][m[2] - 1]]) for m in made}
    return result


def test_filter_audit_equals_the_model(spark):
    rng = random.Random(5)
    given = rows() + [
        (200 + i, rng.choice(["#tag ", "", "AAA BBB ", "x " * 120]) + prose(EN, rng.choice([3, 150]), i % 7), rng.choice(["en", "de", None, ""]), None, None)
        for i in range(60)
    ]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in given if r[0] is not None] + [(200, 1, 1), (9999, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = [tuple(r) for r in interaction.audit(table(spark, given), frame).collect()]
    assert len(found) == len(set(found)) and set(found) == audit_model(given, labels)
    none = interaction.audit(table(spark, []), frame.limit(0))
    assert none.count() == 0
    unlabelled = interaction.audit(table(spark, given), frame.limit(0))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_lattice_counts_orders():
    edges = interaction.lattice(4)
    for f in range(4):
        assert sum(w for s, g, w in edges if g == f) == 24  # every order applies f once
    for state, f, ways in edges:
        assert ways == sum(
            sum(1 << g for g in order[: order.index(f)]) == state for order in permutations(range(4))
        )


def shingle_model(text, words=3):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def join_model(given, percent=90):
    sets = [shingle_model(r[1]) for r in given]
    label = list(range(len(given)))
    for a, b in combinations(range(len(given)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    least = {}
    for x, r in zip(label, given):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    return Counter((r[0], len(s), least.get(x)) for r, s, x in zip(given, sets, label))


def copies(seed=2, base=12, each=14):
    """Texts with copies that differ in a few words, around the threshold, and texts that share a passage."""
    rng = random.Random(seed)
    line = prose(EN, 12, 77)
    given = []
    for b in range(base):
        words = prose(EN, rng.choice([8, 11, 40, 120, 400]), 1000 + b).split()
        for _ in range(each):
            made = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, max(1, len(words) // 60), len(words) // 30])):
                at = rng.randrange(len(made))
                rng.choice([lambda: made.insert(at, rng.choice(EN) + "x"), lambda: made.__setitem__(at, "q" + rng.choice(EN)), lambda: made.pop(at)])()
            given.append((1000 + len(given) * 7 % 1009, rng.choice(["", line + " "]) + " ".join(made), "en", None, None))
    return given


@pytest.mark.parametrize("block,most,anchors", [(1024, 16_384, 3), (3, 4, 3), (1024, 3, 0), (1024, 16_384, 1)])
def test_shingle_join_equals_all_pairs(spark, monkeypatch, block, most, anchors):
    """Also with tiny blocks and lists, and without anchors, where prefixes alone must find every link."""
    monkeypatch.setattr(multimatch, "BLOCK", block)
    monkeypatch.setattr(multimatch, "LIST", most)
    monkeypatch.setattr(multimatch, "ANCHORS", anchors)
    given = rows() + copies()
    found = Counter(map(tuple, multimatch.linked(table(spark, given)).collect()))
    assert found == join_model(given)
    assert len({c for _, _, c in found}) < len(found) - 60


def test_shingle_join_of_an_empty_table(spark):
    assert multimatch.linked(table(spark, [])).count() == 0


def test_one_large_group_of_near_copies(spark):
    words = prose(EN, 150, 4).split()
    rng = random.Random(8)
    given = []
    for i in range(2500):
        made = list(words)
        made[rng.randrange(len(made))] = f"w{i}"
        given.append((i, " ".join(made), "en", None, None))
    found = multimatch.linked(spark.createDataFrame(given, SCHEMA).repartition(4))
    assert found.where("component_id = 0").count() == 2500


def test_groups_equal_all_pairs_in_one_list():
    rng = random.Random(6)
    for _ in range(20):
        base = [rng.randrange(1 << 60) for _ in range(60)]
        sets = []
        for _ in range(25):
            made = set(base[: rng.choice([20, 40, 60])])
            for _ in range(rng.randrange(6)):
                made.discard(rng.choice(base))
                made.add(rng.randrange(1 << 60))
            sets.append(np.array(sorted(made), np.uint64))
        groups = multimatch.Groups(sets, np.zeros(len(sets), int), [[] for _ in sets], 90)
        label = list(range(len(sets)))
        for a, b in groups.links():
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            assert 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]
            label = [label[a] if x == label[b] else x for x in label]
        for a, b in combinations(range(len(sets)), 2):
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                assert label[a] == label[b]
