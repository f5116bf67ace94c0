"""Near copies against all pairs, through every way of finding candidates."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from opslens.llm import components as rounds, jaccard_join as j
from opslens.llm.components import components
from opslens.llm.shingles import shingle_sets


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            common = len(x & sets[b])
            if common and 100 * common >= threshold * (len(x) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted((i, len(sets[k]), min(least[find(k)])) for k, (i, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, other, rows = draw(30), draw(25), []
    for _ in range(8):
        base = draw(rng.choice([12, 30, 80, 150]))
        for _ in range(rng.choice([2, 5, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    for _ in range(60):
        w = draw(rng.choice([10, 40, 60]))
        at = rng.randrange(len(w))
        rows.append(w[:at] + common + w[at:])
    for _ in range(40):
        w, at = draw(6), rng.randrange(6)
        rows.append(w[:at] + other + w[at:])
    rows += [common + other + draw(n) for n in (0, 1, 2, 3, 0, 1)] + [[], ["a"], ["a", "b"], ["b", "a"], ["A", "b"], ["a", "b", "c"]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    return [*rows, (len(rows), None), rows[3], rows[3]]


@pytest.mark.parametrize("frequent, direct, known, slot", [(24, 64, 200_000, 512), (2, 2, 200_000, 4), (2, 2, 5, 3)])
def test_components_of_near_copies(spark, monkeypatch, frequent, direct, known, slot):
    monkeypatch.setattr(j, "DIRECT", direct)
    monkeypatch.setattr(j, "FREQUENT", frequent)
    monkeypatch.setattr(j, "KNOWN", known)
    monkeypatch.setattr(j, "SLOT", slot)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in j.near_components(docs).collect())
    assert got == brute(rows)


def test_one_of_each_group_stays(spark, odd, nothing):
    kept = j.deduplicated(odd)
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert kept.columns == odd.columns and ids == [-1, 0, 1, 2, 3, 4, 6, 7]
    assert j.deduplicated(nothing).count() == 0 and j.near_components(nothing).count() == 0


def test_shingle_sets():
    texts = ["a b c d", "A  B\tC\nd", "a b", "b a", "a", "", " ", "é È a\x85b c", "ab c", "a bc", "x y z " * 9]
    found = [x.tolist() for x in shingle_sets(texts)]
    assert [len(x) for x in found] == [len(shingles(t)) for t in texts]
    assert found == [shingle_sets([t])[0].tolist() for t in texts] and found[0] == found[1] and found[2] != found[3] and found[8] != found[9]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 80)] + [(3000, 3000)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(80)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_links_merge_components(spark):
    rng = random.Random(2)
    of = lambda df: sorted(map(tuple, df.collect()))
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    for more in ([(rng.randrange(400), rng.randrange(400)) for _ in range(90)], [], links[:20], [(900, 901), (901, 5)]):
        assert of(rounds.merged(components(frame(links)), frame(more))) == of(components(frame(links + more)))
    assert of(rounds.merged(components(frame([])), frame(links))) == of(components(frame(links)))


def test_rounds_have_short_plans(spark, monkeypatch):
    """The driver holds the plans of all rounds and renews them at every exchange."""
    exchanges, original = [], rounds.staged

    def counted(df, name):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return original(df, name)

    monkeypatch.setattr(rounds, "staged", counted)
    assert components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")).count() == 10
    assert len(exchanges) > 4 and max(exchanges) <= 4


def test_stage_leaves_no_near_copies_of_five_words(spark, monkeypatch):
    """The pipeline's stage against all pairs at 5 words and 0.8, through slots and frequent tokens too."""
    for name, value in (("DIRECT", 2), ("FREQUENT", 2), ("SLOT", 4)):
        monkeypatch.setattr(j, name, value)
    rng = random.Random(7)
    rows = [(i, t) for i, t in dict(corpus()).items()]
    for _ in range(30):  # one changed word of 50: 0.80 of five-word runs, 0.88 of three-word runs
        base = [f"v{rng.randrange(900)}" for _ in range(50)]
        edited = list(base)
        edited[rng.randrange(10, 40)] = "changed"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(edited))]
    rows += [(len(rows) + k, t) for k, t in enumerate(("a b c d", "a b c d", "a b c", "a b c e"))]
    fives = {}
    for i, t in rows:
        w = words(t)
        fives[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    component = {i: i for i in fives}
    for a in sorted(fives):
        for b in range(a):
            common = len(fives[a] & fives[b])
            if common and 100 * common >= 80 * len(fives[a] | fives[b]) and component[a] != component[b]:
                least, gone = sorted((component[a], component[b]))
                component = {i: least if c == gone else c for i, c in component.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect())
    assert kept == sorted(i for i, c in component.items() if i == c)


def family(n, edits, seed=1):
    """Documents around one base, each with words replaced by common ones."""
    rng = random.Random(seed)
    vocabulary = [f"c{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(edits if edits >= 0 else rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    return rows


def test_families_of_mixed_distances(spark):
    rows = family(300, -1)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in j.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_work_on_a_family_grows_with_its_size(spark, monkeypatch):
    """Documents alike but below the threshold: candidates stay in proportion."""
    made = {}
    for n in (250, 1000):
        counted = []
        original = j._verified
        monkeypatch.setattr(j, "_verified", lambda slim, nodes, pairs, *rest: counted.append(pairs.count()) or original(slim, nodes, pairs, *rest))
        rows = family(n, 7)
        found = j.near_components(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().count()
        monkeypatch.setattr(j, "_verified", original)
        made[n] = sum(counted)
        assert found > 0.9 * n
    assert made[1000] < 6 * made[250] + 1000
