"""Raw queries against loops over every text."""

import random

import pytest

from lexspark.functions.porter import stem
from lexspark.operators import index, rawquery

WORDS = ["run", "runs", "alpha", "beta", "gamma", "running", "runt", "al"]


@pytest.mark.parametrize(
    ("text", "made"),
    [
        ("a b OR c", ("or", ("and", ("leaf", 0), ("leaf", 1)), ("leaf", 2))), ("a OR b AND c", ("or", ("leaf", 0), ("and", ("leaf", 1), ("leaf", 2)))),
        ("a AND b NOT c", ("and", ("leaf", 0), ("not", ("leaf", 1), ("leaf", 2)))), ("(a OR b) c", ("and", ("or", ("leaf", 0), ("leaf", 1)), ("leaf", 2))), ('"AND" NEAR', ("and", ("leaf", 0), ("leaf", 1))),
    ],
)
def test_precedence(text, made):
    assert rawquery.parse(text)[1] == made


def test_leaves():
    (near, filtered, rest), _ = rawquery.parse('NEAR("a b" + c ^d e*, 3) {t -x}' .replace(" -x", " x") + ': f OR -t : ("g""h" )')
    assert [(p.texts, p.prefix, p.first) for p in near.phrases] == [(["a b", "c"], False, False), (["d"], False, True), (["e"], True, False)] and near.near == 3
    assert (filtered.columns, rest.columns, rest.phrases[0].texts) == (frozenset({"t", "x"}), frozenset({"-", "t"}), ['g"h'])


@pytest.mark.parametrize("text", ["", "a AND", "(a", "a)", "NEAR(a, b)", '"a', "a NOT NOT b", "OR", "a : ", "#", "{a : b", "a + AND"])
def test_what_cannot_be_read(text):
    with pytest.raises(ValueError):
        rawquery.parse(text)


def brute(title: str, content: str, leaves, made) -> bool:
    columns = {"title": [stem(w) for w in title.split()], "content": [stem(w) for w in content.split()]}

    def starts(p: rawquery.Phrase, tokens: list[str]) -> tuple[list[int], int]:
        want = [stem(w) for x in p.texts for w in x.split()]
        fits = lambda w, t, last: t.startswith(w) if p.prefix and last else t == w
        at = [i for i in range(len(tokens) - len(want) + 1) if all(fits(w, tokens[i + k], k == len(want) - 1) for k, w in enumerate(want)) and (i == 0 or not p.first)]
        return at, len(want)

    def leaf(x: rawquery.Leaf) -> bool:
        for name, tokens in columns.items():
            if x.columns is not None and (name in x.columns) == ("-" in x.columns):
                continue
            found = [starts(p, tokens) for p in x.phrases]
            if len(found) == 1 and found[0][0]:
                return True
            if len(found) > 1 and any(all(any(s <= m and m - (s + n) <= x.near for s in at) for at, n in found) for m in {s for at, _ in found for s in at}):
                return True
        return False

    if made[0] == "leaf":
        return leaf(leaves[made[1]])
    a, b = (brute(title, content, leaves, m) for m in made[1:])
    return a or b if made[0] == "or" else a and not b if made[0] == "not" else a and b


QUERIES = [
    "run", "ru*", "^alpha", "NEAR(alpha beta, 1)", "NEAR(alpha beta)", 'NEAR("alpha run" gamma*, 2) OR beta', "alpha NOT beta", "(alpha OR beta) NOT (gamma OR runt)", "title : run", "-title : run AND al*",
    '"alpha beta" + ga*', "{title content} : alpha beta", "title : (alpha OR -title : beta)", "nowhere : alpha", "NEAR(run run gamma, 0)", "^run NOT title:run", "beta NOT al* OR runt AND gamma",
]


def test_against_loops(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 2]))), " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 6, 15])))) for i in range(60)]
    rows = spark.createDataFrame([(i << 20, i, 0, t, c, "prose") for i, t, c in texts], "chunk_id long, source_id long, chunk_no int, title string, content string, content_type string")
    index.write_index(rows, str(tmp_path / "i"))
    found = rawquery.search(index.Stored(spark, str(tmp_path / "i")), list(enumerate(QUERIES))).collect()
    for qid, text in enumerate(QUERIES):
        leaves, made = rawquery.parse(text)
        assert {r["chunk_id"] >> 20 for r in found if r["query_id"] == qid} == {i for i, t, c in texts if brute(t, c, leaves, made)}, text
    assert all(r["score"] < 0 for r in found)
    assert rawquery.search(index.Stored(spark, str(tmp_path / "i")), [(1, '"..." OR "?"')]).collect() == []
