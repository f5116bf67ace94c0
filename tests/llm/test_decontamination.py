"""Passages of a benchmark in documents, against full edit distances."""

import random

from opslens.llm import decontamination as d

VOICES = "then gala morin teval ostra quin belor asta dremi fulan corva melin".split()


def prose(rng, n):
    return " ".join("".join(rng.sample(VOICES, 2)) if rng.random() < 0.5 else rng.choice(VOICES) for _ in range(n))


def edits(pattern, text):
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(before[j - 1] + (p != t), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def damaged(rng, letters, n):
    y = list(letters)
    for _ in range(n):
        i, kind = rng.randrange(len(y)), rng.choice("sid")
        y[i : i + (kind != "i")] = [] if kind == "d" else [rng.choice("xyzw")]
    return "".join(y)


def test_every_region_within_budget_is_found():
    rng = random.Random(3)
    items = [(k, prose(rng, n)) for k, n in enumerate((8, 15, 30, 60))]
    held = d.Patterns.of(items)
    for trial in range(120):
        p = rng.randrange(len(held.codes))
        letters = "".join(map(chr, held.codes[p]))
        changed = damaged(rng, letters, rng.randrange(held.budget[p] + 3))
        spaced = " ".join(changed[i : i + 6].upper() for i in range(0, len(changed), 6))
        text = prose(rng, rng.randrange(40)) + " -- " + spaced + "!? " + prose(rng, rng.randrange(40))
        plain = "".join(map(chr, d.normalized(text)[0]))
        expected = any(edits("".join(map(chr, c)), plain) <= b for c, b, i in zip(held.codes, held.budget, held.items, strict=True) if i == held.items[p])
        got = [m for m in d.find(["other", text, ""], held)[1] if m["item_id"] == held.items[p]]
        assert bool(got) == expected


def test_places_and_clean_texts():
    rng = random.Random(4)
    items = [(k, prose(rng, 30)) for k in range(20)]
    held = d.Patterns.of([*items, (99, "too short"), (98, None), (97, "")])
    clean = [prose(rng, 200) for _ in range(40)]
    assert not any(d.find(clean, held))
    inside = clean[0][:301] + " " + items[5][1] + " " + clean[1][:77] + items[6][1]
    (found,) = d.find([inside], held)
    assert [m["item_id"] for m in found] == [5, 6] and inside[found[0]["start"] : found[0]["end"]] == items[5][1]
    half = items[7][1][: len(items[7][1]) * 3 // 4]
    assert [m["item_id"] for m in d.find([half], held)[0]] == [7]


def test_parts_from_the_middle_at_every_offset():
    rng = random.Random(6)
    item = prose(rng, 60)
    letters = "".join(map(chr, d.normalized(item)[0]))
    held = d.Patterns.of([(1, prose(rng, 40)), (2, item), (3, prose(rng, 9))])
    around = "".join(prose(rng, 30).split()), "".join(prose(rng, 30).split())
    part = lambda a, n: letters[a : a + n]
    texts = [around[0] + part(a, 100) + around[1] for a in range(len(letters) - 99)]
    assert all([m["item_id"] for m in found] == [2] for found in d.find(texts, held))
    longer = [around[0] + damaged(rng, part(a, 109), 6) + around[1] for a in range(len(letters) - 108)]
    assert all([m["item_id"] for m in found] == [2] for found in d.find(longer, held))
    assert not any(d.find([around[0] + part(a, 60) + around[1] for a in range(0, 300, 7)], held))


def test_short_items_are_found_as_whole_words(spark):
    rng = random.Random(9)
    items = [(1, "Who wrote Faust?"), (2, "\u4eca\u5929\u7684\u5929\u6c14\u600e\u4e48\u6837\u554a\u4f60"), (3, "two by two"), (4, prose(rng, 40)), (5, "abcdefghi")]
    held = d.Patterns.of(items)
    texts = ["Quiz: who  wrote faust", "whowrote Faust, again", "xwho wrote faust", "who wrote fausts", "who wrote faxst", "x" + items[1][1] + "x",
             items[3][1] + " who wrote Faust", "abcdefghi", prose(rng, 300)]
    assert [[m["item_id"] for m in found] for found in d.find(texts, held)] == [[1], [1], [], [], [], [2], [1, 4], [], []]
    many = [(k, f"item {k} {k * k} and {k + 7}") for k in range(300)]
    found = d.find([t for _, t in many], d.Patterns.of([*many, *items]))
    assert all(k in [m["item_id"] for m in own] for k, own in enumerate(found))
    bench = spark.createDataFrame([*items, (6, None)], "item_id long, text string")
    assert sorted(map(tuple, d.not_searched(bench).collect())) == [(3, 8), (5, 9), (6, 0)]


def test_frames(spark, odd, nothing, monkeypatch):
    rng = random.Random(5)
    items = [(k, prose(rng, 25)) for k in range(6)]
    bench = spark.createDataFrame([*items, (2, items[2][1]), (None, None)], "item_id long, text string")
    planted = spark.createDataFrame([(50, "x " + items[1][1], "a"), (51, items[2][1] + items[4][1], None)], "doc_id long, text string, source string")
    extra = odd.unionByName(planted, allowMissingColumns=True)
    expected = {(50, 1), (51, 2), (51, 4)}
    assert {(r.doc_id, r.item_id) for r in d.matches(extra, bench).collect()} == expected
    kept = d.decontaminated(extra, bench)
    assert kept.columns == extra.columns and kept.count() == odd.count() and kept.where("doc_id in (50, 51)").count() == 0
    monkeypatch.setattr(d, "BLOCK", 200)
    assert {(r.doc_id, r.item_id) for r in d.matches(extra, bench).collect()} == expected
    assert d.matches(nothing, bench).count() == 0 and d.decontaminated(odd, bench.where("false")).count() == odd.count()
