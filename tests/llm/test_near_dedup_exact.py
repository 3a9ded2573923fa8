"""Near duplicates against a brute force on rational numbers."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np

from gristmill.llm import near_dedup as N

SCHEMA = "doc_id long, text string"


def bag(text, k=5):
    w = (text or "").split()
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def similarity(x, y):
    if not x.keys() & y.keys():
        return Fraction(0)
    keys, n = x.keys() | y.keys(), Counter()
    for j in keys:
        n[x[j], y[j]] += 1
    return sum(Fraction(1) * n[a, b] / sum(m * max(Fraction(c, a), Fraction(d, b)) for (c, d), m in n.items()) for a, b in n if a and b)


def classes(rows, least=Fraction(4, 5)):
    bags = {i: bag(t) for i, t in rows}
    label = {i: i for i in bags}
    for a in bags:
        for b in bags:
            if a < b and label[a] != label[b] and similarity(bags[a], bags[b]) >= least:
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    return label


def found(spark, rows, **parameters):
    return {r.doc_id: r.class_id for r in N.near_dedup(spark.createDataFrame(rows, SCHEMA), **parameters).collect()}


def shifted(name, common, only):
    """Two texts with so many common shingles, and so many of their own each."""
    w = [f"{name}{i}" for i in range(common + 2 * only + 4)]
    return " ".join(w[: common + only + 4]), " ".join(w[only:])


def test_all_ties_are_links():
    for union in range(5, 2001, 5):
        common = union * 4 // 5
        row, x = np.zeros(union, np.int64), np.ones(union)
        for take, answer in ((common, True), (common - 1, False)):
            y = (np.arange(union) < take).astype(float)
            assert N.reaches(row, x, y, N.prob_jaccard(row, x, y, 1), 0.8).tolist() == [answer]


def test_ties_of_weighted_sets():
    rng, seen = random.Random(1), 0
    for _ in range(20000):
        x, y = ([rng.randrange(4) for _ in range(5)] for _ in "xy")
        if not (any(x) and any(y)):
            continue
        exact = similarity(Counter(dict(enumerate(x))), Counter(dict(enumerate(y))))
        row, fx, fy = np.zeros(5, np.int64), np.array(x, float), np.array(y, float)
        used = (fx > 0) | (fy > 0)
        row, fx, fy = row[used], fx[used], fy[used]
        seen += exact == Fraction(4, 5)
        assert N.exact_similarity(fx, fy) == exact
        assert N.reaches(row, fx, fy, N.prob_jaccard(row, fx, fy, 1), 0.8).tolist() == [exact >= Fraction(4, 5)]
    assert seen


def test_pairs_at_exactly_the_least_similarity(spark):
    rows = []
    for u, union in enumerate((10, 15, 30, 65, 70, 75)):
        common = union * 4 // 5
        w = [f"u{union}_{i}" for i in range(union + 4)]
        only = (union - common) // 2
        rows += [(10 * u, " ".join(w[: common + only + 4])), (10 * u + 1, " ".join(w[only:]))]
    rows += [(100 + i, t) for i, t in enumerate(shifted("n", 7, 1))]
    answer = classes(rows)
    assert answer[1] == 0 and answer[101] == 101
    assert found(spark, rows) == answer


def one_bucket(monkeypatch):
    """Gives all documents one bucket, so that every link away from the leader hangs on the bound."""
    whole = N._sign

    def signer(k, bands, rows):
        signed = whole(k, bands, rows)

        def sign(batches):
            import pyarrow as pa

            for b in signed(batches):
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([[7]] * b.num_rows, pa.list_(pa.int64()))], names=b.schema.names)

        return sign

    monkeypatch.setattr(N, "_sign", signer)


def test_large_groups_with_repeated_shingles_and_ties(spark, monkeypatch):
    one_bucket(monkeypatch)
    rng = random.Random(4)
    base = [f"w{j}" for j in range(200)]
    texts = [" ".join(base)]
    for c in range(70):  # near copies, so that the group is large
        t = list(base)
        t[rng.randrange(200)] = f"z{c}"
        texts.append(" ".join(t))
    for part in (120, 110, 60):  # parts of the leader, and the same twice or more: no shingle but at the seams is beyond it
        for at in (0, 200 - part):
            own = base[at : at + part]
            texts += [" ".join(own), " ".join(own * 2), " ".join(own * 3 + [f"y{part}"])]
    for part in (50, 84, 124):  # a part of the leader and a part of that part, at exactly 0.8
        texts += [" ".join(base[30 : 30 + part]), " ".join(base[30 : 30 + 4 + (part - 4) * 4 // 5])]
    rows = list(enumerate(texts))
    answer = classes(rows)
    assert len(set(answer.values())) > 3
    assert found(spark, rows, rounds=None) == answer


def test_common_passage_with_own_words_hides_no_link(spark):
    """Many texts of one passage and words of their own; the passage alone and the passage twice are similar to each other only."""
    rng = random.Random(6)
    passage = [f"p{j}" for j in range(200)]
    rows = [(i, " ".join(passage + [f"o{i}_{j}" for j in range(66)])) for i in range(400)]
    rows += [(10001, " ".join(passage)), (10002, " ".join(passage * 2)), (10003, " ".join(passage[:120])), (10004, " ".join(passage[:120] * 2))]
    rng.shuffle(rows)
    answer = found(spark, rows)
    assert answer[10002] == 10001 and answer[10004] == 10003
    assert all(answer[i] == i for i in range(400))


def test_links_that_two_rounds_pass_over(spark, monkeypatch):
    """Texts of one passage and some of a few blocks, in one group: many are like one another to nearly 0.8."""
    one_bucket(monkeypatch)
    rng = random.Random(1)
    passage, blocks = [f"p{j}" for j in range(100)], [[f"b{i}_{j}" for j in range(8)] for i in range(12)]
    rows = [(i, " ".join(passage + [w for b in sorted(rng.sample(range(12), 5)) for w in blocks[b]])) for i in range(70)]
    assert found(spark, rows) == classes(rows)


def test_no_more_than_three_comparisons(spark, monkeypatch):
    """However alike the texts of a group are: rounds without end made plans and tables without end."""
    one_bucket(monkeypatch)
    whole, seen = N._with_sets, []
    monkeypatch.setattr(N, "_with_sets", lambda *a: seen.append(a) or whole(*a))
    rng = random.Random(3)
    passage, blocks = [f"p{j}" for j in range(100)], [[f"b{i}_{j}" for j in range(8)] for i in range(12)]
    rows = [(i, " ".join(passage + [w for b in sorted(rng.sample(range(12), 5)) for w in blocks[b]])) for i in range(70)]
    assert found(spark, rows) == classes(rows) and len(seen) <= 3


def test_words_of_equal_polynomials_are_no_copies(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    assert found(spark, [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]) == {1: 1, 2: 2}


def test_keep_one_per_class(spark):
    rows = [(2, "a b c d e f g", 1), (1, " a b c d e f g", 2), (1, " a b c d e f g", 2), (3, None, 3), (4, "", 4), (None, "a b c d e f g", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    assert sorted(((r.doc_id, r.class_id) for r in N.keep_one_per_class(df).collect()), key=str) == [(1, 2), (3, 3), (None, 5)]
    assert N.keep_one_per_class(df.limit(0)).collect() == []


def test_near_copies_are_compared_with_their_centre(spark, monkeypatch):
    """Pairs of near copies that what they lost keeps apart are not compared, and no link is lost."""
    one_bucket(monkeypatch)
    whole, seen = N._with_sets, []
    monkeypatch.setattr(N, "_with_sets", lambda pairs, *a: seen.append(pairs.count()) or whole(pairs, *a))
    rng = random.Random(8)
    base, rows = [f"w{j}" for j in range(149)], []
    for i in range(160):
        t = list(base)
        for at in rng.sample(range(149), 1 if i in (70, 71) else rng.choice((3, 4, 5, 6)) if i else 3):
            t[at] = f"z{i}_{at}"
        rows.append((i, " ".join(t)))
    answer = classes(rows)
    assert 5 < len(set(answer.values())) < 155
    assert found(spark, rows) == answer
    assert sum(seen) < 4 * len(rows)


def test_bound_on_pairs_keeps_all_that_are_similar(spark):
    """Against the definition, for sets with repeated shingles, at the first key that both have."""
    rng, rows, similar = random.Random(9), [], []
    for case in range(3000):
        keys = rng.sample(range(500), rng.randrange(1, 9))
        x = {j: rng.choice((1, 1, 1, 2, 3)) for j in keys}
        y = {j: w if rng.random() < 0.8 else rng.choice((1, 2)) for j, w in x.items() if rng.random() < 0.95}
        if not y:
            continue
        if rng.random() < 0.3:
            y[600] = 1  # a shingle of its own
        first = next(j for j in keys if j in y)
        member = lambda s: (sum(s.values()), case, sum(s.values()) - len(s), sum(w for j, w in s.items() if j != 600 and keys.index(j) >= keys.index(first)), [sum(j % N.PARTS == i for j in s if j != 600) for i in range(N.PARTS)])  # noqa: B023, E731
        rows.append((member(x), member(y)))
        similar.append(similarity(Counter(x), Counter(y)) >= Fraction(4, 5))
    of = "struct<total:int,id:long,extra:int,left:long,parts:array<int>>"
    kept = [r.kept for r in spark.createDataFrame(rows, f"x {of}, y {of}").select(N._may_reach(0.8).alias("kept")).collect()]
    assert all(k for k, s in zip(kept, similar, strict=True) if s)
    assert sum(similar) > 500 and not all(kept)


def test_rows_of_frequent_keys_are_joined_once(spark):
    big = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 9), ("c", 10)], "key string, i int")
    small = spark.createDataFrame([("a", 9, 1), ("b", 1, 2)], "key string, n int, v int")
    joined = N._join_hot(big, small, "key", 3)
    assert sorted(tuple(r) for r in joined.collect()) == [("a", i, 1) for i in range(9)] + [("b", 9, 2)]
    assert "LeftAnti" not in joined._jdf.queryExecution().optimizedPlan().toString()
