import random

from pyspark.sql import functions as F

from tessera.llm import ngram_join
from tessera.llm._graph import components
from tessera.session import prepare


def brute(rows):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and None not in (rows[i][0], rows[j][0]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ñandú", "x,"]
    shared = [r.choice(vocab) for _ in range(12)]
    texts = []
    for _ in range(n):
        k = r.random()
        if texts and k < 0.55:
            w = (r.choice(texts) or "").split()
            for _ in range(r.randint(0, 4)):
                if w:
                    at = r.randrange(len(w))
                    w[at : at + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 1)
        else:
            w = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 5, 6, 20, 60, 90]))]
            if k > 0.8:
                w += shared
        texts.append(r.choice([" ", "\n", " \t "]).join(w) if r.random() > 0.02 else None)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (None, texts[5]), (None, None)]
    return [(d, t.upper() if t and d and d % 11 == 0 else t) for d, t in rows]


def test_matches_brute_force(spark):
    prepare(spark)
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("node", F.lit(1))
        got = sorted((tuple(r) for r in ngram_join.link(df).collect()), key=str)
        assert got == brute(rows)


def test_star_of_copies_that_do_not_link_to_each_other(spark):
    r = random.Random(9)
    base = [f"v{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for at in r.sample(range(0, 200, 5), 3):
            w[at] = f"u{i}_{at}"
        rows.append((i, " ".join(w)))
    rows.append((99, " ".join(base[:150])))
    got = sorted((tuple(x) for x in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_one_group_of_copies_and_one_shared_passage(spark):
    r = random.Random(12)
    word = lambda: f"v{r.randrange(5000)}"
    copy, passage = " ".join(word() for _ in range(80)), " ".join(word() for _ in range(30))
    rows = [(i, copy) for i in range(120)] + [(200 + i, " ".join(word() for _ in range(r.choice([2, 6, 20, 60]))) + " " + passage) for i in range(120)]
    rows += [(400 + i, copy + " " + word()) for i in range(20)] + [(500, "long " * 50_000), (501, "long " * 50_001)]
    got = sorted((tuple(x) for x in ngram_join.link(spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, TEXT int, at int")).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert ngram_join.link(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)}


def test_finished_shuffles_are_deleted_during_the_join(spark, monkeypatch):
    sc = spark.sparkContext._jsc.sc()
    left, release = [], ngram_join.release

    def watched(session):
        left.append((sc.env().mapOutputTracker().shuffleStatuses().size(), sc.newShuffleId()))
        release(session)

    monkeypatch.setattr(ngram_join, "release", watched)
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 5}x{k}" for k in range(40 + i % 3))) for i in range(60)], "doc_id long, text string")
    assert ngram_join.link(docs).select("component_id").distinct().count() == 5
    # of all shuffles made so far, those that still are there
    (_, first), (live, made) = left[0], left[-1]
    assert first < made and live < made - first
