"""Published cases of the ten measures, five features each, in column order."""

import pytest

from tablekin.operators import rank

ORDER = ["ndcg", "cohen_kappa", "r2", "levenshtein", "kendall_tau", "weighted_tau", "rbo", "damerau", "jaro_winkler", "hamming"]

# Two score lists and the measures they must give.
CASES = [
    (
        [0.06648338418371605, 0.39740813537379127, 0.17082314974356527, 0.1827804538411454, 0.182504876857782],
        [0.11916284304879206, 0.44115565432519876, 0.020981123484759223, 0.20005663342605268, 0.21864374571519724],
        [0.957321174851, 0.0, 0.506509498449, 0.2, 0.6, 0.543795620438, 0.65, 0.4, 0.622222222222, 0.2],
    ),
    (
        [0.014638333148723962, 0.18183926516075402, 0.41760902569843295, 0.2128686495197801, 0.173044726472309],
        [0.026383825328464096, 0.35328775310880267, 0.130346627053812, 0.210991736033089, 0.27899005847583236],
        [0.926232859498, 0.0, -0.486473772705, 0.2, 0.0, 0.297445255474, 0.783333333333, 0.2, 0.76, 0.2],
    ),
    (
        [0.015265671148226967, 0.19974616363620035, 0.3847037613665437, 0.21747758621902288, 0.18280681763000609],
        [0.06727535011046781, 0.41482079853957965, 0.12678703306064412, 0.08868070365091976, 0.3024361146383888],
        [0.938979229275, 0.0, -1.126318221599, 0.4, 0.2, 0.43795620438, 0.85, 0.6, 0.88, 0.2],
    ),
    (
        [0.03876249540793293, 0.1508779290744626, 0.14650030280496393, 0.08290836602972608, 0.5809509066829145],
        [0.4695682729381705, 0.12179511098599256, 0.11633120620017164, 0.12677240111006702, 0.1655330087655983],
        [0.839842595593, -0.25, -0.903381355597, 0.0, -0.2, -0.304744525547, 0.416666666667, 0.0, 0.466666666667, 0.0],
    ),
    (
        [0.0884967320261438, 0.04689542483660132, 0.0013398692810457468, 0.05156862745098041, 0.06640522875816995],
        [0.09052287581699349, 0.04797385620915035, 0.0, 0.05179738562091505, 0.06673202614379087],
        [1.0, 1.0, 0.998249737034, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    ),
    (
        [0.0004042300120462538, 0.05398668514475121, 0.023135258753577498, 0.00043041439519745744, 0.036038321734539906],
        [0.00043396369075366845, 0.05618974533190296, 0.025282150891805515, 7.042389662134922e-05, -0.0001205044903713759],
        [0.847222068751, 0.25, 0.387400807348, 0.4, 0.2, 0.014598540146, 0.583333333333, 0.4, 0.6, 0.4],
    ),
]


def frame(spark, cases):
    rows = [
        (str(k), f"f{i}", i, x, y) for k, (a, b) in enumerate(cases) for i, (x, y) in enumerate(zip(a, b))
    ]
    return spark.createDataFrame(rows, "target string, feature string, pos int, score_a double, score_b double")


def test_published_cases(spark):
    got = {int(r["target"]): r for r in rank.score_ranks(frame(spark, [(a, b) for a, b, _ in CASES])).collect()}
    for k, (_, _, want) in enumerate(CASES):
        assert [got[k][m] for m in ORDER] == pytest.approx(want, abs=1e-9)


def test_identical_lists_give_one(spark):
    scores = [0.4, 0.0, 0.1, 0.0, 0.3, 0.2, 0.0]
    for mode in ("reference", "top_weighted"):
        row = rank.score_ranks(frame(spark, [(scores, scores)]), mode=mode).first()
        assert [row[m] for m in ORDER] == pytest.approx([1.0] * 10)


def test_ties_follow_column_order(spark):
    row = rank.score_ranks(frame(spark, [([0.0, 0.5, 0.0], [0.2, 0.2, 0.9])])).first()
    assert (row["rank_join_a"], row["rank_join_b"]) == ("213", "231")


def test_symmetric_measures(spark):
    a, b = CASES[1][:2]
    forth = rank.score_ranks(frame(spark, [(a, b)])).first()
    back = rank.score_ranks(frame(spark, [(b, a)])).first()
    for m in ("cohen_kappa", "levenshtein", "kendall_tau", "weighted_tau", "rbo", "damerau", "hamming"):
        assert forth[m] == pytest.approx(back[m])


def test_lists_longer_than_the_character_range(spark):
    a = [float(i % 37) + i / 1000 for i in range(120)]
    b = [float(i % 41) + i / 1000 for i in range(120)]
    row = rank.score_ranks(frame(spark, [(a, b)])).first()
    from tablekin.functions.sequences import edit_distance

    place = lambda s: [sorted(range(120), key=lambda i: (-s[i], i)).index(j) + 1 for j in range(120)]
    assert row["levenshtein"] == pytest.approx(1 - edit_distance(place(a), place(b)) / 120)
